import hashlib
import random
import re

import pytest

from rillstone.llm.pii import KINDS, LEVELS, base_spans, contexts, identifiers, personal_data, redact, trusted_patterns


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


FIXED = ["4111 1111 1111 1111 x", "1.2.3.4.5.6.7.8.9", "a@b@c.de", "999.1.1.1 001.2.3.4", "+1 (555) 123-4567.", "1" * 400, "a" * 500 + "@", "+" + "1-" * 300]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    rng = random.Random(seed)
    texts = FIXED + ["".join(rng.choice("a@.-+1 9(0)5é%") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [base_spans(t) for t in texts] == [brute(t) for t in texts]


def test_query_and_edges(make_docs, edge_rows):
    got = sorted([tuple(r) for r in personal_data(make_docs(edge_rows)).collect()], key=str)
    want = []
    for i, text, *_ in edge_rows:
        spans = brute(text or "")
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((i, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == sorted(want, key=str)
    assert personal_data(make_docs([])).collect() == []


def valid_card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_trusted_context_finds_unseen_identifiers(make_docs):
    from tests.llm.conftest import rows_of

    rng = random.Random(1)
    texts = [f"your card number {valid_card(rng)} is stored" for _ in range(30)]
    texts += ["your card number 1234-XYZ-77 is stored", "the part number 88990011 is stored", "number 424242 alone"]
    got = {r.doc_id: r.spans for r in personal_data(make_docs(rows_of(texts))).collect()}
    assert got[30] == "card:17:28" and got[31] == "" and got[32] == ""
    assert all(got[i].startswith("card:17:") for i in range(30))


def test_redaction(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = redact(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    hidden = [r for r in rows if r.text and r.text.startswith("mail me")]
    assert {r.text for r in hidden} == {"mail me at [EMAIL] or [PHONE]"} and all(r.n_chars == len(r.text) for r in hidden)
    assert sorted(str(r.text) for r in rows if not (r.text or "").startswith("mail me")) == sorted(str(r[1]) for r in edge_rows if not (r[1] or "").startswith("mail me"))


def test_whole_identifiers():
    text = "ring (555) 123-4567, jane[at]example.org jim (at) example (dot) org or ann at example dot org; x1 and 12, 10.0.0.1 (id77889). The end"
    got = [text[s:e] for s, e in identifiers(text, base_spans(text))]
    assert got == ["(555) 123-4567", "jane[at]example.org", "jim (at) example (dot) org", "ann at example dot org", "x1", "12", "id77889"]


@pytest.mark.parametrize("seed", range(3))
def test_identifiers_keep_off_spans_and_end(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "1", " ", "(", ")", "[at]", " dot ", " at ", "@", ".", "-", "_", "+", "é", "\n"]) for _ in range(rng.randint(0, 40)))
        base = base_spans(text)
        spans = identifiers(text, base)
        assert all(s < e for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not any(s < f and b < e for s, e in spans for b, _, f in base)
        # no digit outside of all spans
        assert all(any(s <= i < e for s, e in spans) or any(s <= i < e for s, _, e in base) for i, c in enumerate(text) if c == "1"), text


def test_unseen_identifiers_are_redacted_whole(make_docs):
    from tests.llm.conftest import rows_of

    rng = random.Random(2)
    texts = [f"please call me on +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} today" for _ in range(30)]
    texts += [f"you may write to user{i}@example.org soon" for i in range(30)]
    first = len(texts)
    texts += ["please call me on (555) 123-4567 today", "please call me on 911 today", "you may write to jane[at]example.org soon", "you may write to them soon"]
    got = {r.doc_id: r.text for r in redact(make_docs(rows_of(texts))).collect()}
    assert [got[first + i] for i in range(4)] == ["please call me on [PHONE] today", "please call me on [PHONE] today", "you may write to [EMAIL] soon", "you may write to them soon"]


def test_instances_seed_the_next_round(make_docs):
    from tests.llm.conftest import rows_of

    rng = random.Random(3)
    texts = [f"your card number {valid_card(rng)} is stored" for _ in range(40)]
    texts += [f"your card number AB-{i}-7 is stored" for i in range(4)] + [f"the member code AB-{i}-7 is valid" for i in range(4)]
    got = {r.doc_id: r.spans for r in personal_data(make_docs(rows_of([*texts, "the member code ZZ-9 is valid"]))).collect()}
    assert got[len(texts)] == "card:16:20"


def test_the_second_round_finds_what_the_first_cannot(make_docs):
    """Cards seed "card number", whose other instances seed "member code", whose others seed "desk slot"."""
    from tests.llm.conftest import rows_of

    rng = random.Random(5)
    tails = ["soon", "again", "now", "there", "then", "today", "here"]
    end = lambda: rng.choice(tails) + rng.choice("abcdefghij") * rng.randint(1, 9)
    texts = [f"card number {valid_card(rng)} {end()}" for _ in range(60)]
    texts += [f"card number AB-{i}-7 {end()}" for i in range(7)] + [f"member code AB-{i}-7 {end()}" for i in range(7)]
    texts += [f"member code C{i}C {end()}" for i in range(1)] + ["member code ZZ-9 stop", "desk slot QQ-1 stop"]
    docs = make_docs(rows_of(texts))
    last = len(texts) - 2
    spans = {k: {r.doc_id: r.spans for r in personal_data(docs, bootstraps=k).collect()} for k in (0, 1, 3)}
    assert spans[0][60] == "card:12:18" and spans[0][67] == "" and spans[0][last] == ""
    assert spans[1][67] == "card:12:18" and spans[1][last] == "card:12:16"
    assert spans[3][last] == "card:12:16" and spans[3][last + 1] == ""


def test_back_off_to_one_word_and_the_word_after(make_docs):
    from tests.llm.conftest import rows_of

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = [f"{word()} {word()} dial +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} {word()}" for _ in range(40)]
    texts += [f"{word()} {word()} u{i}@example.org writes {word()}" for i in range(40)]
    texts += [f"{word()} dial 0800-77 {word()}", f"{word()} jane[at]example.org writes", f"{word()} room 0800 {word()}"]
    got = {r.doc_id: r.spans for r in personal_data(make_docs(rows_of(texts))).collect()}
    assert [got[80 + k].split(":")[0] for k in range(3)] == ["phone", "email", ""]


def test_doubtful_patterns_are_not_trusted(make_docs):
    """A word that stands before identifiers of several kinds, or before few seeds, finds nothing."""
    from tests.llm.conftest import rows_of

    rng = random.Random(7)
    texts = [f"see {valid_card(rng)} x{i}" for i in range(10)] + [f"see X-{i} y{i}" for i in range(10)] + [f"ring {valid_card(rng)} w", "ring R-77 v"]
    got = {r.doc_id: r.spans for r in personal_data(make_docs(rows_of(texts))).collect()}
    assert all(got[i] == "" for i in [*range(10, 20), 21])


def brute_patterns(seen, rounds, least_confidence, bootstraps):
    """The graph in plain dictionaries."""
    seed, other = {}, {}
    for kind, cs, value in seen:
        for c, o in cs:
            other[c, value] = min(o, other.get((c, value), o))
            if (c, value) not in seed or (kind or "") > (seed[c, value] or ""):
                seed[c, value] = kind
    fits = lambda kind, value: kind == "email" or any("0" <= x <= "9" for x in value)

    def scored():
        instances, seeds, words = {}, {}, {}
        for (c, v), s in seed.items():
            for k in KINDS:
                instances[c, k] = instances.get((c, k), 0) + fits(k, v)
                seeds[c, k] = seeds.get((c, k), 0) + (s == k)
                words.setdefault((c, k), set()).update([other[c, v]] if s == k else [])
        kept = {p for p in instances if seeds[p] >= LEVELS[p[0].split()[0]] and (p[0].startswith("two ") or len(words[p]) >= 3)}
        conf = {p: seeds[p] / instances[p] for p in kept}
        for _ in range(rounds):
            miss = {}
            for (c, v), s in seed.items():
                for k in KINDS:
                    if s is None and (c, k) in kept and fits(k, v):
                        miss[v, k] = miss.get((v, k), 1.0) * max(1 - conf[c, k], 1e-9)
            gain = {}
            for (c, v), s in seed.items():
                for k in KINDS:
                    if s is None and (c, k) in kept and (v, k) in miss:
                        gain[c, k] = gain.get((c, k), 0.0) + 1 - miss[v, k]
            conf = {p: (seeds[p] + gain.get(p, 0.0)) / instances[p] for p in kept}
        return {p: x for p, x in conf.items() if x >= least_confidence and seeds[p] / instances[p] >= least_confidence / 2}

    trusted = scored()
    for _ in range(bootstraps):
        new = {}
        for (c, v), s in seed.items():
            for k in KINDS:
                if s is None and (c, k) in trusted and fits(k, v):
                    new[v] = max(new.get(v, (0.0, "")), (trusted[c, k], k))
        if not new:
            break
        for (c, v), s in list(seed.items()):
            if s is None and v in new:
                seed[c, v] = new[v][1]
        for p, x in scored().items():
            trusted[p] = max(x, trusted.get(p, 0.0))
    return trusted


@pytest.mark.parametrize("seed", range(2))
def test_trusted_patterns_against_a_plain_graph(spark, seed):
    rng = random.Random(seed)
    seen = []
    for _ in range(500):
        kind = rng.choice([*KINDS[:2], KINDS[0], None])
        value = f"{rng.choice('abc')}{rng.randint(0, 60)}" if kind or rng.random() < 0.8 else rng.choice(["x.y", "p_q"])
        strong = {"email": "two mail to", "ip": "before host"}.get(kind, f"after w{rng.randint(0, 3)}")
        word = rng.choice("abcd") if kind == "email" or rng.random() < 0.1 else "e"
        seen.append((kind, [(c, word) for c in (strong, f"before b{rng.randint(0, 4)}", f"around z{rng.randint(0, 30)} y") if rng.random() < 0.8], value))
    frame = spark.createDataFrame(seen, "kind string, contexts array<struct<context:string,other:string>>, value string")
    got = {(r.context, r.kind): r.confidence for r in trusted_patterns(frame, least_confidence=0.5).collect()}
    want = brute_patterns(seen, 3, 0.5, 3)
    assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_contexts():
    text = "one\nCall: Jim at x1-22 now\nthen"
    assert contexts(text, 17, 22) == [("two jim at", ""), ("around at now", "jim"), ("shape at a9-9", "jim"), ("before at", "jim"), ("after now", "at")]
    assert contexts("x1", 0, 2) == [] and contexts("12 x", 0, 2) == [("after x", "")]
