"""SimHash near-duplicates, decontamination and token counts against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from quorumlake.llm import decontam, simhash, tokens

from .conftest import SF, WORD


def brute_fp(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    x, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    low = {}
    for d, f in rows:
        r = find(fps.index(f))
        low[r] = min([v for v in (low.get(r), d) if v is not None], default=None)
    return {f: low[find(i)] for i, f in enumerate(fps)}


def test_near_duplicates(docs, odd_docs):
    rows = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = [(r.doc_id, brute_fp(r.text)) for r in rows.collect()]
    comp = brute_components(want)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(rows).collect()]
    assert Counter(got) == Counter((d, f, comp[f]) for d, f in want)
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and ids[7] == 0 and ids[5] == 1 and ids[None] == 1 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 2048])
def test_links_keep_all_components(spark, block):
    r = random.Random(block)
    fps = {r.getrandbits(64) for _ in range(500)}
    for _ in range(30):
        base = r.getrandbits(64)
        for _ in range(r.choice([2, 5, 60])):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
            base = r.choice([base, x])
    want = brute_components([(f, f) for f in fps])
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {x.node & (2**64 - 1): x.root for x in simhash.components(simhash.links(nodes, block=block)).collect()}
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        mine.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def norm(text):
    w = [x for x in (text or "").lower().translate({ord(c): None for c in decontam.PUNCTUATION}).split() if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_decontamination(spark, docs, odd_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    r = random.Random(3)
    items = {x.item_id: x.text for x in bench.collect()}
    planted = []
    for k in range(60):
        item = r.choice(list(items.values())).split()
        for _ in range(r.choice([0, 1, 1, 2])):
            i = r.randrange(len(item))
            item[i : i + 1] = r.choice([[], [item[i], "zz"], ["qq"]])
        filler = [f"f{r.randrange(500)}" for _ in range(r.randrange(40))]
        at = r.randrange(len(filler) + 1)
        planted.append((10_000 + k, " ".join(filler[:at] + item + filler[at:])))
    extra = spark.createDataFrame([*planted, (None, list(items.values())[0]), (None, "clean row")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(extra)
    want = {}
    for x in rows.collect():
        sh = norm(x.text)
        for i, t in items.items():
            b = norm(t)
            if not b or not set(b) & set(sh):
                continue
            for s in range(max(len(sh) - len(b), 0) + 1):
                a, c = Counter(sh[s : s + len(b)]), Counter(b)
                m = sum((a & c).values())
                sim = m / (sum(a.values()) + len(b) - m)
                if sim >= 0.8:
                    want[x.doc_id, i] = max(want.get((x.doc_id, i), 0), sim)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.contaminated(rows, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    left = decontam.drop_contaminated(rows, bench).collect()
    # only the contaminated rows go: the clean row that shares its (missing) id with one stays
    dirty = {i for i, _ in want if i is not None}
    assert Counter(x.doc_id for x in left) == Counter(x.doc_id for x in rows.collect() if x.doc_id not in dirty and x.text != list(items.values())[0])
    assert "clean row" in {x.text for x in left}


TEXTS = ["", "  ", "It's a TEST, isn't it?! we'LL see 123 x² ½ ﬁ ŉ", "İstanbul ΣΑΣ ΟΔΟΣ", "<|startoftext|>hello <|endoftext|> world<|endoftext|>", "<|ENDOFTEXT|>", "été café e\ń", "日本語 テスト 😀👍🏽", "a b c\x1cd\x85e​f", "''s '' 's' 'llama' ''ve", "ª º µ ß ẞ ſ ﬀ", "x" * 5000, ("word " * 30_000) + "<|endoftext|>" + "y" * 70_000, "\x00\x01\x7f control", "¡Hola! «quoted» ñandú ¿qué?"]


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(9)
    alphabet = "aAbéÉß'sltr 12½!?.,<|>\n\tœŁ́漢Σ"
    texts = [*TEXTS, *["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(3000)]]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([*[(10_000 + i, t) for i, t in enumerate(texts)], (None, None)], "doc_id long, text string"))
    want = Counter()
    for x in rows.collect():
        t = x.text or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want[x.doc_id, len(t.encode()), n, n > 2048] += 1
    assert Counter(map(tuple, tokens.count_tokens(rows, path).collect())) == want
    assert tokens.count_tokens(docs.limit(0), path).count() == 0
    whole = tokens.prove_whole_tokens(open(path, encoding="utf-8").read())
    assert {"the", "house"} <= whole and all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in list(whole)[:500])


def test_only_uncertain_words_go_to_the_tokenizer_uncut():
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)
    counter = tokens.Counter(spec, tokens.prove_whole_tokens(spec), tokens.prove_certain_characters(spec))
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    prose = "It’s a “typographic” text — costs €12… isn’t it? 日本語のテキスト。中文维基百科 한국어 Привет, мир! 🙂 "
    assert counter.count(prose * 900) == size(prose * 900) and counter.fallback == 0
    mixed = prose + "ΟΔΟΣ é <|endoftext|> "
    assert counter.count(mixed) == size(mixed) and counter.fallback == 3
    for c in range(0x10000):  # every character of the basic plane beside others
        if not 0xD800 <= c < 0xE000:
            text = f"ab{chr(c)}c {chr(c)} 1{chr(c)}'s{chr(c)}{chr(c)} É{chr(c)}"
            assert counter.count(text) == size(text), hex(c)
    counter.count(" ".join("ж" * n for n in range(60, 70)))
    assert max(map(len, counter.known.keys() - counter.whole)) <= tokens.LONGEST_KNOWN
