"""PII, quality, sharding, mixing and chat against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from quorumlake.llm import chat, mixing, pii, quality, sharding

from .conftest import SF, WORD


def both(docs, odd_docs):
    return docs.select("doc_id", "text", "lang", "source").union(odd_docs.select("doc_id", "text", "lang", "source"))


def luhn(d):
    t = [int(c) for c in reversed(d)]
    return sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PATTERNS.items()}
    kinds = list(PATTERNS)
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted((s, kinds.index(k), e) for k, v in found.items() for s, e in v))
    return [len(found[k]) for k in kinds], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_pii_base(docs, odd_docs):
    rows = both(docs, odd_docs)
    want = Counter((r.doc_id, *base_spans(r.text)[0], base_spans(r.text)[1]) for r in rows.select("doc_id", "text").collect())
    got = pii.digest(pii.find(rows)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 5


def test_pii_added(odd_docs):
    rows = {r.doc_id: r.spans for r in pii.digest(pii.find(odd_docs)).collect()}
    assert [x.split(":")[0] for x in rows[10].split(",")] == ["phone_local", "ssn", "iban"]
    clean = {r.doc_id: r.text for r in pii.redact(odd_docs).collect()}
    assert clean[10].startswith("call phone [PHONE_LOCAL] my ssn [SSN] IBAN [IBAN] bad GB82")
    assert "GB82 WEST 1234 5698 7654 33" in clean[10]


def test_pii_hypothesis(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("a1b2.3@-+ ()_é9.0 1") for _ in range(r.randint(0, 60))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.digest(pii.find(rows)).collect():
        counts, sha, spans = base_spans(texts[x.doc_id])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256] == [*counts, sha], (texts[x.doc_id], spans, x.spans)


def quality_counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_quality_counts(docs, odd_docs, spark):
    rows = both(docs, odd_docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = Counter((r.doc_id, *quality_counts(r.text)) for r in rows.select("doc_id", "text").collect())
    got = quality.judge(rows, labels).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality.COUNTS], r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_threshold_is_the_exact_binomial_one(spark):
    rows = [("en", i / 1000, i % 10 > 0) for i in range(1000)] + [("xx", 0.9, True)] * 3
    scored = spark.createDataFrame(rows, "stratum string, score double, good boolean")
    got = {r.stratum: r.cutoff for r in quality.risk_controlled_cutoffs(scored, 0.3, 0.05).collect()}

    def best(scores, strata):
        n = len(scores)
        ok = [c for c in quality.CUTOFFS if sum(math.comb(n, i) * 0.3**i * 0.7 ** (n - i) for i in range(sum(s >= c for s in scores) + 1)) <= 0.05 / (strata * len(quality.CUTOFFS))]
        return min(ok, default=None)

    good = [s for _, s, g in rows if g]
    want = {"en": best([s for t, s, g in rows if g and t == "en"], 3), "*": best(good, 3)}
    assert got == want


def test_quality_empty(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(docs, labels).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_sharding(docs, odd_docs):
    rows = both(docs, odd_docs)
    limit = 20_000
    got = sharding.assign(rows, limit).collect()
    assert len(got) == rows.count()
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_docs, r.depth) == (size[r.shard], count[r.shard], len(r.shard))
        assert r.shard_bytes <= limit or r.oversize
    parents = Counter()
    for s in size:
        for d in range(len(s)):
            parents[s[:d]] += size[s]
    assert all(v > limit for v in parents.values())  # nothing was split that fitted
    assert not any(s in parents for s in size)  # no shard lies inside another
    h = {r.doc_id: r.shard for r in got if r.doc_id is not None}
    assert all(format(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), "060b").startswith(s[:60]) for k, s in h.items())  # an id above the limit splits further, by text
    placed = sharding.shard_documents(odd_docs, limit)
    assert placed.columns == [*odd_docs.columns, "shard", "shard_bytes"] and placed.count() == odd_docs.count()
    assert sharding.assign(docs.limit(0)).count() == 0


def test_mixing(docs, odd_docs):
    rows = both(docs, odd_docs)
    got = mixing.mix(rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(rows.repartition(7)).collect()), key=str)
    size = Counter()
    for r in rows.collect():
        size[r.source] += len(re.findall(WORD, r.text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * size[s]]
        for s in full or list(free):
            target[s] = min(share[s], 3 * size[s])
        left -= sum(3 * size[s] for s in full)
        free = free - set(full) if full else set()
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(re.findall(WORD, r.text or ""))
    assert all(words[s] == taken[s] for s in size)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat(spark):
    log = spark.read.parquet(f"{SF}/conversations.parquet")
    extra = [(900, 0, "user", "hi"), (900, 1, "assistant", "yo"), (901, 0, "user", "hi"), (902, 0, "user", "hi"), (902, 1, "assistant", "yo"), (902, 2, None, None), (903, 0, "user", "hi"), (903, 0, "user", "hi"), (903, 1, "assistant", "yo"), (903, 2, None, None), (None, 0, "user", "x"), (904, None, "user", "hey")]
    extra += [(905, i, "user", f"t{i}") for i in range(600)] + [(906, i, "user", f"t{i}") for i in range(599)]
    both = log.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(extra, "conv_id long, turn int, role string, text string"))
    by = defaultdict(set)
    for r in both.collect():
        if r.conv_id is not None:
            by[r.conv_id].add((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    turns = {c: tuple(x[1:] for x in sorted(v)) for c, v in by.items()}
    inner = {v[:i] for v in turns.values() for i in range(1, len(v))}
    whole = defaultdict(list)
    for c, v in turns.items():
        if v not in inner:
            whole[v].append(c)
    want = {min(c): (len(v), len(c), "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in v)) for v, c in whole.items()}
    got = defaultdict(list)
    for r in chat.format_chats(both.selectExpr("*", "1 AS pos", "2 AS block", "3 AS h1")).collect():
        got[r.conv_id, r.n_turns, r.n_logged].append((r.part, r.rendered))
    assert {c: (n, k, "".join(x for _, x in sorted(v))) for (c, n, k), v in got.items()} == want
    assert chat.format_chats(both.limit(0)).count() == 0


def test_pii_context_raises_and_lowers(spark):
    good = "GB82 WEST 1234 5698 7654 32"
    rows = [(1, f"number {good}"), (2, f"example {good}"), (3, f"sample iban {good}"), (4, "order 212-555-1234"), (5, "phone 212-555-1234"), (6, "phone 112-555-1234"), (7, "order by phone 212-555-1234"), (8, "ssn " * 30 + "x" * 60 + " 123-45-6789 123-45-6780")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {d for d, s in got.items() if s} == {1, 3, 5}


def test_pii_of_very_many_matches(spark):
    """Offsets and redaction over several chunks, with characters outside ASCII and overlapping kinds."""
    parts = [f"é😀 u{i}@x-{i % 7}.org, +49 30 1234{i:04d} 10.0.{i % 300}.1 4111111111111111 tel 212-555-{i % 10000:04d}" for i in range(1500)]
    text = " ".join(parts) + " end"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no match é" * 900)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    counts, sha, _ = base_spans(text)
    assert [got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone, got[1].base_sha256] == [*counts, sha] and counts[0] == 1500
    spans = sorted((int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in got[1].spans.split(",")))
    want, at = "", 0
    for s, k, e in spans:
        if s >= at:
            want += text[at:s] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, e)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == want + text[at:] and clean[2] == clean[3] == "" and clean[4] == "no match é" * 900
    assert len(spans) > 2 * pii.CHUNK


def test_chat_with_many_turns_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "HEAVY", 50)
    r = random.Random(3)
    rows = [(1, None, r.choice(["user", "assistant", None]), f"m{r.randrange(10**6)}") for _ in range(700)] + [(1, 5, "user", f"t{i}") for i in range(300)] + [(1, 900, "user", "end")]
    rows += [(2, t, a, b) for _, t, a, b in rows[:-1]] + [(3, 0, "user", "x")] + rows[:40]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)).collect()
    want = sorted({(t if t is not None else -1, a or "", b) for c, t, a, b in rows if c == 1})
    text = "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for _, a, b in want)
    assert {(x.conv_id, x.n_turns, x.n_logged) for x in got} == {(1, len(want), 1), (3, 1, 1)}  # conversation 2 is a prefix of 1
    assert "".join(x.rendered for x in sorted(got, key=lambda x: x.part) if x.conv_id == 1) == text
