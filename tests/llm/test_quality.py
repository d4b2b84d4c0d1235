import re
from collections import Counter

import numpy as np

from rillstone.llm.quality import quality_rules


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if times[tuple(words[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


TEXTS = ["x y z w v x y z w v", "a\n\na\na \nb # c", "one two three four five six seven eight nine ten", "w " * 50, "a\r\na\r\n", "é|é <b>"]


def test_counts_and_base_rules(make_docs, edge_rows):
    from tests.llm.conftest import rows_of

    rows = edge_rows + rows_of(TEXTS, 50)
    got = quality_rules(make_docs(rows)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[k] for k in names) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_bad_host_is_rejected(make_docs):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "bad" if i % 100 and i < 400 else good, None, "bad" if i < 400 else f"good{i % 9}", 1, 1, True, 1, "", "", 0.0, "") for i in range(1000)]
    got = {r.doc_id: r.kept for r in quality_rules(make_docs(rows)).collect()}
    assert not any(got[i] for i in range(400)) and all(got[i] for i in range(400, 1000))


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_strings_that_collide_modulo_a_power_of_two(make_docs):
    from tests.llm.conftest import rows_of

    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    texts = [f"{x}\n{y}", f"{x}\n{y}\n{x}", f"1 2 {x} 3 4 . 1 2 {y} 3 4", f"1 2 {x} 3 4 . 1 2 {x} 3 4"]
    got = {r.doc_id: r for r in quality_rules(make_docs(rows_of(texts))).collect()}
    assert [got[i].n_dup_lines for i in range(4)] == [0, 1, 0, 0] and [got[i].n_repeat_words for i in range(4)] == [0, 0, 0, 10]


def test_bytes_decide_when_all_hashes_are_equal(monkeypatch):
    from rillstone.llm import bytehash, quality

    class Same(bytehash.RangeHash):
        def __call__(self, start, end):
            return super().__call__(start, end) * np.uint64(0)

    monkeypatch.setattr(quality, "RangeHash", Same)
    monkeypatch.setattr(quality, "mix", lambda x: x * np.uint64(0))
    for text in [*TEXTS, "p q r\ns t u\np q r\nab\nab\nba"]:
        data = text.encode()
        got = quality.count_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert tuple(int(got[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)[:5]


def test_host_rates_by_hand(make_docs):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(10 * h + i, "bad" if i < f else good, None, f"host{h}", 1, 1, True, 1, "", "", 0.0, "") for h, f in enumerate([0, 1, 9, 3]) for i in range(10)]
    rates = [0.0, 0.1, 0.9, 0.3]
    m = sum(rates) / 4
    v = sum((x - m) ** 2 for x in rates) / 3
    w = m * (1 - m) / v - 1
    want = [((f + m * w) / (10 + w)) for f in (0, 1, 9, 3)] if w > 0 else [(f + 1) / 12 for f in (0, 1, 9, 3)]
    got = quality_rules(make_docs(rows)).collect()
    assert all(abs(r.host_rate - want[r.doc_id // 10]) < 1e-12 and r.kept == (not r.base_failed and want[r.doc_id // 10] <= 0.5) for r in got)
    assert {r.doc_id // 10 for r in got if not r.base_failed and not r.kept} == {2}


def test_empty_table(make_docs):
    assert quality_rules(make_docs([])).collect() == []
