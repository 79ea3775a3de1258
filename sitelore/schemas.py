"""Table and nested-record schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """Parsed form of a DDL string; needs a running session."""
    return T.StructType.fromDDL(ddl)


TABLES: dict[str, str] = {
    "pages": (
        "id string, url string, domain string, content_hash string, page_type string, page_type_confidence double,"
        " http_status int, last_crawled timestamp, last_changed timestamp, crawl_frequency string, version int,"
        " requires_js boolean, cms_detected string, meta string, created_at timestamp, updated_at timestamp"),
    "entities": (
        "id string, category string, subcategory string, data string, domain string, page_id string,"
        " confidence double, aieo_score double, embedding array<float>, searchable_text string,"
        " is_verified boolean, created_at timestamp, updated_at timestamp"),
    "relationships": (
        "id string, from_entity_id string, to_entity_id string, relationship_type string, meta string,"
        " created_at timestamp"),
    "crawl_queue": (
        "id string, url string, domain string, priority int, source string, status string, attempts int,"
        " max_attempts int, scheduled_for timestamp, started_at timestamp, completed_at timestamp, error string,"
        " created_at timestamp"),
    "domain_profiles": (
        "domain string, pages_discovered bigint, pages_indexed bigint, crawl_frequency string, rate_limit_ms int,"
        " email_pattern string, cms string, is_claimed boolean, meta string, last_crawled timestamp,"
        " created_at timestamp, updated_at timestamp"),
    "api_keys": (
        "id string, key_hash string, name string, owner_email string, tier string, rate_limit_per_day int,"
        " queries_today bigint, queries_total bigint, is_active boolean, created_at timestamp,"
        " last_used_at timestamp"),
    "personal_indexes": (
        "id string, user_id string, name string, tier string, url_limit int, urls_indexed int, status string,"
        " started_at timestamp, completed_at timestamp, error string, meta string, created_at timestamp,"
        " updated_at timestamp"),
    "personal_index_urls": (
        "id string, personal_index_id string, url string, domain string, status string, priority int,"
        " http_status int, crawled_at timestamp, interpreted_at timestamp, entities_extracted int, error string,"
        " created_at timestamp"),
    "personal_entities": ("personal_index_id string, entity_id string, user_id string"),
    "ops_log": (
        "id string, ts timestamp, level string, component string, message string, context string, domain string,"
        " url string"),
    "action_submissions": (
        "id string, action_id string, domain string, api_key_id string, user_ref string, submitted_data string,"
        " status string, approval_token string, approval_token_expires_at timestamp, approved_by string,"
        " approved_at timestamp, executed_at timestamp, http_status int, response_preview string, success boolean,"
        " failure_reason string, created_at timestamp, updated_at timestamp"),
}

DEFAULTS: dict[str, dict[str, object]] = {
    "pages": {"crawl_frequency": "monthly", "version": 1, "requires_js": False, "meta": "{}"},
    "entities": {"confidence": 0.0, "aieo_score": 0.0, "is_verified": False},
    "crawl_queue": {"priority": 5, "source": "seed", "status": "pending", "attempts": 0, "max_attempts": 3},
    "domain_profiles": {"rate_limit_ms": 1000, "is_claimed": False},
    "api_keys": {"tier": "free", "rate_limit_per_day": 1000, "queries_today": 0, "queries_total": 0,
                 "is_active": True},
    "action_submissions": {"submitted_data": "{}", "status": "pending_approval"},
}

# one wide row per fetched page
RAW_PAGE = ("page_id bigint, url string, html string")

LINK = "struct<href:string,text:string,location:string,is_external:boolean,rel:string>"
FIELD = ("struct<name:string,type:string,required:boolean,label:string,placeholder:string,"
         "options:array<string>,pattern:string,value:string>")
FORM = f"struct<action:string,method:string,fields:array<{FIELD}>,submit_label:string,encoding:string>"
IMAGE = "struct<src:string,alt:string,width:int,height:int,caption:string,context:string>"
VIDEO = "struct<platform:string,video_id:string,src:string,title:string>"
META = ("struct<title:string,description:string,h1:string,h2s:array<string>,canonical:string,robots:string,"
        "lang:string,og_title:string,og_description:string,og_image:string,og_type:string,twitter_card:string,"
        "author:string,published_at:string,modified_at:string>")
EXTRACTED = (
    "page_id bigint, url string, cleaned_dom string, text string, dom_nodes int, html_size_bytes bigint,"
    f" meta {META}, headings array<struct<level:int,text:string>>, jsonld array<string>, cms_hints array<string>,"
    f" links array<{LINK}>, forms array<{FORM}>, images array<{IMAGE}>, videos array<{VIDEO}>")

# `data` payload per category, for from_json
ENTITY_DATA = {
    "contact": "name string, role string, email string, phone string, department string, seniority string",
    "organisation": "name string, type string, industry string, address string, phone string, website string,"
                    " abn string, accreditations array<string>, employees string,"
                    " operatingHours map<string,string>, serviceArea array<string>",
    "product": "name string, provider string, productType string,"
               " price struct<amount:string,currency:string,qualifier:string>, specs map<string,string>,"
               " warranty map<string,string>, rating struct<score:string,count:string>, availability string,"
               " finance struct<available:boolean,amount:string,period:string>",
    "action": "type string, purpose string, endpoint string, method string, contentType string,"
              " fields string, hiddenFields map<string,string>, submitLabel string, successRate string,"
              " responseHandling struct<success:string,error:string>",
    "location": "address string, suburb string, postcode string, state string, country string, lat string,"
                " lng string, locationType string, name string",
    "event": "name string, date string, time string, type string, registrationUrl string, deadline string,"
             " audience array<string>",
    "review": "subject string, sources array<struct<platform:string,rating:string,count:string>>,"
              " overallRating string, totalReviews string,"
              " sentiment struct<positive:array<string>,negative:array<string>,trending:string>",
    "regulation": "name string, jurisdiction string, authority string, appliesTo array<string>, rule string,"
                  " effectiveDate string, lastUpdated string, source string",
}


def conform(df: DataFrame, table: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project to the columns of `table` in order, and `extra`: cast, add missing ones as their default or null."""
    have = set(df.columns)
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in struct(TABLES[table]):
        if field.name in have:
            column = F.col(field.name).cast(field.dataType)
        else:
            column = F.lit(defaults.get(field.name)).cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns, *extra)
