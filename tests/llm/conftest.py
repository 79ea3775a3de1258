import pandas as pd
import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, n long, h1 long, "
          "hash long, key long, batch int, chunk int, score double, component_id long, copies long, text_crc32 long")


def frame(spark, rows):
    """Documents (doc_id, text[, source]) with further columns whose names operators use."""
    full = []
    for k, row in enumerate(rows):
        doc_id, text = row[0], row[1]
        source = row[2] if len(row) > 2 else ["a", "b", None][k % 3]
        full.append((doc_id, text, "en", source, None if text is None else len(text), 1, 2, 3, 4, 5, 6, 7, 8, 0.5, 9, 1, 1))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    words = [f"w{k * 7 % 97}" for k in range(400)]
    line = "this line is long enough to be counted as a repeated one"
    return [
        (5, None), (6, ""), (7, " ".join(words)), (8, " ".join(words)), (9, " ".join(words[:-9]) + " x y z"),
        (10, "short"), (10, "short"), (None, "no id at all, but some text"), (None, None), (11, "\n".join([line] * 3)),
        (12, line.upper() + "  "), (13, f"a\n{line}\nb"), (14, f"{line}\n"), (15, f"\t{line}"), (16, line), (17, "é" * 600),
        (18, "a" * 20_000), (19, "long " * 30_000 + "end"), (20, "a  b   c \n\n d<|endoftext|> \x1c e"),
        (21, "Ä ö ü 漢字 " * 50), (22, "one two three"), (23, "One two THREE"), (24, "\x00 odd ퟿"), (-3, "negative id"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).limit(0)


@pytest.fixture(scope="session")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
