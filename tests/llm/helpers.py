"""Small tables with every awkward case, and comparisons with SQL twins on tables made here."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import plain  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, start: int = 0, stem: str = "w") -> str:
    return " ".join(f"{stem}{i}" for i in range(start, start + n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long text, ties, copies and repeated rows."""
    base = words(80)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # an exact copy
        (3, base + "\n", "en", "b"),  # equal without white space, and longer
        (4, words(79) + " other", "en", "b"),  # a near copy
        (5, None, "en", "a"),
        (6, "", "de", None),
        (7, " \t\n\x0b\x0c\r ", None, "b"),
        (8, "two words", None, None),
        (9, "TWO Words", "de", "c"),
        (10, words(20_000, 7), "de", "c"),
        (11, "é ß \U0001f600  x　y \x1c z it's <|endoftext|> THEY'LL", "fr", "c"),
        (12, words(60, 500, "q") + " $$$ ### ***", "fr", "c"),
        (12, words(60, 500, "q") + " $$$ ### ***", "fr", "c"),  # a repeated row
        (13, "a b c " * 40, "fr", "c"),
        (14, "one line here\n" * 30, "fr", "c"),
        (15, words(90, 900, "z"), "es", ""),
        (None, words(70, 3, "n"), "es", "d"),
        (None, None, None, None),
        (16, words(60, 40), "en", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder_of(tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same_as_twin(df, twin: str, folder: str, *names: str) -> None:
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    cursor = con.execute(twin)
    columns = sorted(d[0] for d in cursor.description)
    assert columns == sorted(df.columns)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    theirs = sorted((str([plain(r[k]) for k in at]) for r in cursor.fetchall()))
    mine = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert mine == theirs
