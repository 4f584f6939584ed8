import math
import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(dict(zip(names, row))[c]) for c in cols)) for row in result.fetchall())
    assert got == want


#: What the rows of queries without SQL must satisfy: (condition of every row, number of rows as a table or a number at least).
WANTED = {
    "strict_addresses": ("(strict is null or strict <> '') and (first_to is null or first_to <> '')", "parse_eml"),
    "clean_documents": (r"not rlike(text, '[\\x{200B}\\x{FEFF}]| \\n|  |\\n\\n\\n|^\\s|\\s$')", "documents"),
    "clean_bodies": (r"not rlike(body, '[\\x{200B}\\x{FEFF}]| \\n|  |\\n\\n\\n|^\\s|\\s$')", "parse_eml"),
    "ml_with_rules": ("verdict in ('Phishing', 'Legitimate') and rules_label is not null and agree = ((verdict = 'Phishing') = (rules_label <> 'LOW'))", 2),
    "model_report": ("support > 0 and precision between 0 and 1 and recall between 0 and 1 and f1 between 0 and 1 and accuracy > 0.5", 2),
    **{f"train_predict_{m}": ("verdict in ('Phishing', 'Legitimate') and percent between 50 and 100 and shown = format_string('%.2f', percent)", 2) for m in ("nb_complement", "nb_multinomial", "logistic_regression", "decision_tree")},
}


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"p\d", n)))
def test_query_without_sql(spark, sf, name):
    condition, rows = WANTED[name]
    df = entry.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) and df.where(f"not coalesce({condition}, false)").count() == 0
    assert df.count() == spark.read.parquet(f"{sf}/{rows}.parquet").count() if isinstance(rows, str) else df.count() >= rows


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0
