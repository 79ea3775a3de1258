"""Training pairs from pages and model responses, and their two export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_TYPES = ("classify", "contacts", "products", "actions")


def training_pairs(pages: DataFrame, responses: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(input, output, prompt_type) for every response (page_id, prompt_type, response) of a page's DOM.

    `max_chars` is the input size of the model service; None keeps the whole DOM.
    """
    dom = F.coalesce("cleaned_dom", F.lit(""))
    body = dom if max_chars is None else F.substring(dom, 1, max_chars)
    inputs = pages.select("page_id", F.concat(F.lit("URL: "), F.col("url"), F.lit("\n\nPage content:\n"), body)
                          .alias("input"))
    asked = inputs.select("page_id", "input", F.explode(F.array(*[F.lit(p) for p in PROMPT_TYPES])).alias("prompt_type"))
    return asked.join(responses, ["page_id", "prompt_type"]).select(
        "page_id", "input", F.col("response").alias("output"), "prompt_type")


def to_instructions(pairs: DataFrame,
                    template: str = "Extract structured entities from the web page content. Extractor: %s.") -> DataFrame:
    """Instruction, input and output; `template` takes the prompt type."""
    return pairs.select(F.format_string(template, "prompt_type").alias("instruction"), "input", "output")


def to_chat(pairs: DataFrame, template: str = "You extract entities from web pages. Task: %s") -> DataFrame:
    """One JSON document of system, user and assistant messages per pair, next to the pair's other columns."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(message("system", F.format_string(template, "prompt_type")),
                       message("user", F.col("input")), message("assistant", F.col("output")))
    keys = [c for c in pairs.columns if c not in ("input", "output", "prompt_type")]
    return pairs.select(*keys, F.to_json(F.struct(messages.alias("messages"))).alias("value"))


def turns_to_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", part: str | None = None) -> DataFrame:
    """Multi-turn tables (key, turn, role, text) as one JSON document per conversation.

    One document gathers its turns. Where conversations have no natural bound, name a column `part` that cuts them.
    """
    packed = turns.groupBy(key, (F.col(part) if part else F.lit(0)).cast("bigint").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("t"))
    messages = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return packed.select(key, "part", F.to_json(F.struct(messages.alias("messages"))).alias("value"))
