"""typed views over the entity payload, and their refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.operators.analytics import domain_summary
from sitelore.session import cut_lineage
from sitelore.sources.keyed import KeyedTable
from sitelore.sources.tables import TableStore

_COMMON = ("id", "domain", "page_id", "confidence", "aieo_score", "searchable_text", "is_verified", "created_at",
           "updated_at")

# view column: (JSON path, type or None for text)
_FIELDS: dict[str, dict[str, tuple[str, str | None]]] = {
    "contact": {c: (c, None) for c in ("name", "role", "email", "phone", "department", "seniority")},
    "organisation": {
        "name": ("name", None), "org_type": ("type", None), "industry": ("industry", None),
        "address": ("address", None), "phone": ("phone", None), "website": ("website", None), "abn": ("abn", None),
        "service_area": ("serviceArea", None), "accreditations": ("accreditations", None)},
    "product": {
        "name": ("name", None), "provider": ("provider", None), "product_type": ("productType", None),
        "price_amount": ("price.amount", "double"), "price_currency": ("price.currency", None),
        "price_qualifier": ("price.qualifier", None), "rating_score": ("rating.score", "double"),
        "rating_count": ("rating.count", "int")},
    "action": {
        "action_type": ("type", None), "purpose": ("purpose", None), "endpoint": ("endpoint", None),
        "method": ("method", None), "fields": ("fields", None), "submit_label": ("submitLabel", None)},
    "location": {
        "name": ("name", None), "address": ("address", None), "suburb": ("suburb", None),
        "postcode": ("postcode", None), "state": ("state", None), "country": ("country", None),
        "lat": ("lat", "double"), "lng": ("lng", "double"), "location_type": ("locationType", None)},
    "event": {
        "name": ("name", None), "date": ("date", None), "time": ("time", None), "event_type": ("type", None),
        "registration_url": ("registrationUrl", None), "deadline": ("deadline", None), "audience": ("audience", None)},
    "review": {
        "subject": ("subject", None), "sources": ("sources", None), "overall_rating": ("overallRating", "double"),
        "total_reviews": ("totalReviews", "int"), "sentiment": ("sentiment", None)},
    "regulation": {
        "name": ("name", None), "jurisdiction": ("jurisdiction", None), "authority": ("authority", None),
        "applies_to": ("appliesTo", None), "rule": ("rule", None), "effective_date": ("effectiveDate", None),
        "last_updated": ("lastUpdated", None), "source": ("source", None)},
}


def _payload(specs: dict[str, tuple[str, str | None]]) -> str:
    """from_json schema of the fields a view reads; every leaf is text."""
    nested: dict[str, list[str]] = {}
    for path, _ in specs.values():
        head, _, leaf = path.partition(".")
        nested.setdefault(head, []).append(leaf)
    return ", ".join(f"{head} struct<{', '.join(f'{leaf}: string' for leaf in leaves)}>" if leaves != [""]
                     else f"{head} string" for head, leaves in nested.items())


def typed_view(entities: DataFrame, category: str, min_confidence: float = 0.5) -> DataFrame:
    """Rows of one category above the confidence bound, payload fields as columns. The payload is parsed once per row.

    Numbers that do not parse become null. Array and object fields stay JSON text.
    """
    specs = _FIELDS[category]
    kept = entities.filter((F.col("category") == category) & (F.col("confidence") > min_confidence))
    common = [c for c in _COMMON if c in entities.columns]
    parsed = kept.select(*common, F.from_json("data", _payload(specs)).alias("__p"))
    return parsed.select(*common, *[
        (F.col(f"__p.{path}").try_cast(kind) if kind else F.col(f"__p.{path}")).alias(name)
        for name, (path, kind) in specs.items()])


def contacts_view(entities: DataFrame) -> DataFrame:
    """F1a."""
    return typed_view(entities, "contact")


def organisations_view(entities: DataFrame) -> DataFrame:
    """F1b."""
    return typed_view(entities, "organisation")


def products_view(entities: DataFrame) -> DataFrame:
    """F1c."""
    return typed_view(entities, "product")


def actions_view(entities: DataFrame) -> DataFrame:
    """F1d."""
    return typed_view(entities, "action")


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "contacts_view": contacts_view,
    "organisations_view": organisations_view,
    "products_view": products_view,
    "actions_view": actions_view,
    "locations_view": lambda e: typed_view(e, "location"),
    "events_view": lambda e: typed_view(e, "event"),
    "reviews_view": lambda e: typed_view(e, "review"),
    "regulations_view": lambda e: typed_view(e, "regulation"),
    "domain_summary": domain_summary,
}


def refresh_views(store: TableStore, root: str, changed_domains: DataFrame | None = None) -> dict[str, str]:
    """recompute the views as parquet.

    With `changed_domains` only those domains are recomputed; the other rows are carried over from the last refresh.
    """
    spark = store.spark
    entities = store.read("entities")
    views = TableStore(spark, root)
    written = {}
    for name, build in VIEWS.items():
        out = build(entities)
        current = views.path(name)
        if changed_domains is not None and current is not None:
            touched = build(entities.join(changed_domains, "domain", "left_semi"))
            kept = spark.read.parquet(current).join(changed_domains, "domain", "left_anti")
            out = kept.unionByName(touched)
        version = int(current.rsplit("v=", 1)[1]) + 1 if current else 1
        path = f"{views.root}/{name}/v={version}"
        out.write.mode("overwrite").parquet(path)
        written[name] = path
    return written


def changed_rows(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("domain",)) -> DataFrame:
    """(key, old_<keep>, new_<keep>, change) of the rows that two versions of a table do not share; change is inserted,
    updated or deleted. Only keys, kept columns and row hashes are moved."""
    def hashed(df: DataFrame, side: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{side}_{c}") for c in keep], F.xxhash64(*old.columns).alias(f"{side}_hash"))

    both = hashed(old, "old").join(hashed(new.select(*old.columns), "new"), key, "full_outer")
    change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "deleted").otherwise("updated")
    return both.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).withColumn("change", change).drop("old_hash", "new_hash")


class MaintainedViews:
    """the views as tables by key that follow the entities, rewriting only folders in which rows change."""

    def __init__(self, store: TableStore, root: str, names: tuple[str, ...] = tuple(VIEWS), parts: int = 16):
        self.store, self.names = store, names
        empty = store.read("entities").limit(0)
        self.tables = {}
        for name in names:
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VIEWS[name](empty).schema)
            self.tables[name] = KeyedTable(store.spark, f"{root.rstrip('/')}/{name}", schema, self.key(name), parts)

    @staticmethod
    def key(name: str) -> str:
        return "domain" if name == "domain_summary" else "id"

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def build(self, version: int | None = None) -> None:
        """Fill the views from all entities."""
        entities = self.store.read("entities", version)
        for name, table in self.tables.items():
            table.write(VIEWS[name](entities))

    def follow(self, before: int, after: int) -> dict[str, list[int]]:
        """Bring the views from one version of the entities to another; the rewritten folders of each view.

        Views of single entities take the rows of changed ids; the summary takes the domains that they are or were in.
        """
        entities = self.store.read("entities", after)
        changes = cut_lineage(changed_rows(self.store.read("entities", before), entities))
        ids = changes.select("id").distinct()
        domains = changes.select(F.explode(F.array("old_domain", "new_domain")).alias("domain")).dropna().distinct()
        written = {}
        for name, table in self.tables.items():
            key = self.key(name)
            touched = ids if key == "id" else domains
            fresh = VIEWS[name](entities.join(touched, key, "left_semi"))
            batch = touched.join(fresh.withColumn("__held", F.lit(True)), key, "left")

            def merge(stored: DataFrame, new: DataFrame, key: str = key) -> DataFrame:
                return stored.join(new.select(key), key, "left_anti").unionByName(
                    new.filter("__held").select(*stored.columns))

            written[name] = table.upsert(cut_lineage(batch), merge)
        return written
