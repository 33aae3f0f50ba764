import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tarn.llm import exact_dedup as ed
from tests.llm.conftest import ODD

LOWER = str.maketrans(ed.UPPER, ed.LOWER)


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in ed.exact_dedup(df, rank=lambda i: -i, **options).collect()), key=str)


def test_odd_rows(as_docs):
    rows = ODD + [(10, "ALPHA BETA gamma delta epsilon zeta", "en", "z"), (11, "É", "fr", "z"), (12, "é", "fr", "z")]
    assert run(as_docs(rows, "h", "t", "g_size", "kept", "keep_id")) == brute(rows)


def test_colliding_hashes_are_told_apart_by_bytes(as_docs):
    rows = [(i, f"text {i % 7}", None, None) for i in range(50)]
    assert run(as_docs(rows), hash128=lambda t: F.lit("same")) == brute(rows)


def test_empty_table(as_docs):
    assert run(as_docs([])) == []
