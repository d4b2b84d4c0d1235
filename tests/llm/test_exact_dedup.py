import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillstone.llm.exact_dedup import exact_dedup, keep_documents


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for i, text in rows:
        g = groups[norm(text)]
        out.append((i, min(g)[3], len(g), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute([r[:2] for r in edge_rows])
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("hash_of", [lambda t: F.unhex(F.lit("00" * 16)), lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0"))])
def test_collisions_of_all_128_bits(make_docs, edge_rows, hash_of):
    """Different texts under one hash: the bytes decide, as brute force does."""
    from tests.llm.conftest import rows_of

    rows = edge_rows + rows_of(["same", "sa me", "diff", "d iff", "else", "e l s e", "else"], 50)
    got = exact_dedup(make_docs(rows), hash_of=hash_of).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute([r[:2] for r in rows])
    assert sum(r.kept for r in got) == len({norm(r[1]) for r in rows}) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).collect() == []
    assert keep_documents(make_docs([])).collect() == []


def test_kept_documents(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = keep_documents(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in edge_rows})


def test_longest_stays_then_least_id(make_docs):
    from tests.llm.conftest import rows_of

    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(make_docs(rows_of(["a b", "ab", " ab", "a b", "x"]))).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (0, False), 3: (0, False), 4: (4, True)}
