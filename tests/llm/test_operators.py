"""Each operator against a plain model on small fixtures, with the odd rows in every one of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.llm import decontamination, quality_classifier, quality_rules, secret_scan, simhash_dedup, source_mix, span_dedup, suffix_dedup, token_counts, url_filter
from echolith.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nü", "xi", "omikron", "pi", "rho", "sigma", "tau", "ypsilon"]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(VOCAB) + rng.choice(VOCAB) + rng.choice(["", "", "", ".", ","]))
        out.append("\n" if rng.random() < 0.03 else " ")
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    out = [*base, base[3], base[3], base[5] + " end", base[6].replace("alpha", "ALPHA"), "intro words here.\n" + passage + "\nafter", passage, "other start.\n" + passage]
    return [*out, None, "", "   ", "x", "a b c", "word " * 400, "\n".join([passage[:90]] * 6), prose(rng, 3000), "é" * 500]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with nulls and repeats, and columns whose names operators use inside."""
    rows = [(None if i == 7 else i, t, f"s{i % 5}" if i % 6 else None, len(t or ""), "clash", 1.0, [1]) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _id string, size double, key array<int>").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


# Spans of sentences


def sentence_model(text, piece=16, window=12):
    """Words of each sentence; of a long one, of its pieces: a word ends a piece that had the least hash while some window was read."""
    out = []
    for part in re.split(r"(?<=[.!?])\s+|\n", text):
        words = part.split()
        if len(words) <= piece:
            out += [words] if words else []
            continue
        ranks, chosen, ends = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], None, set()
        for last in range(window - 1, len(words)):
            first = last - window + 1
            if chosen is None or chosen < first:
                chosen = max(k for k in range(first, last + 1) if ranks[k] == min(ranks[first : last + 1]))
            elif ranks[last] < ranks[chosen]:
                chosen = last
            ends.add(chosen + 1)
        cuts = [0, *sorted(ends - {len(words)}), len(words)]
        out += [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def spans_model(rows):
    order = sorted({(i is None, -1 if i is None else i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    first, gone = {}, defaultdict(set)
    places = []
    for null, i, t in order:
        units = [tuple(w) for w in sentence_model(t)]
        whole = {(a, b) for a in range(len(units)) for b in range(a + 2, min(len(units), a + 16) + 1) if sum(map(len, units[a:b])) >= 15}
        places += [(None if null else i, t, a, b, tuple(units[a:b])) for a, b in whole if b == min(y for x, y in whole if x == a) or a == max(x for x, y in whole if y == b)]
    # Within a document spans come by their first sentence, then their length.
    rank = {(None if null else i, t): k for k, (null, i, t) in enumerate(order)}
    for i, t, a, b, part in sorted(places, key=lambda x: (rank[x[0], x[1]], x[2], x[3])):
        if first.setdefault(part, (i, t, a, b)) != (i, t, a, b):
            gone[i, t].update(range(a, b))
    return gone


def test_span_dedup(docs, empty):
    rows = [(i, t) for i, t, _ in rows_of(docs)]
    gone = spans_model(rows)
    got = span_dedup.dedup_spans(docs).collect()
    assert len(got) == len(rows) and sum(len(x) for x in gone.values()) > 20
    want = []
    for i, t in rows:
        units = [] if t is None else sentence_model(t)
        cut = gone[i, t]
        want.append((i, None if t is None else tuple(w for k, ws in enumerate(units) if k not in cut for w in ws), len(units), len(cut)))
    assert Counter((r.doc_id, None if r.text is None else tuple(r.text.split()), r.n_sentences, r.n_removed) for r in got) == Counter(want)
    assert {r.doc_id: r.text for r in got if not r.n_removed and r.doc_id is not None}.items() <= dict(rows).items()
    assert span_dedup.dedup_spans(empty).count() == 0


def test_span_chunks_agree(docs, monkeypatch):
    """Spans settled in chunks of every size and packed into any number of ranges: the same result."""
    whole = Counter(span_dedup.dedup_spans(docs).collect())
    for chunk, size in ((1, 100), (300, 1000), (10_000, 1 << 30)):
        monkeypatch.setattr(span_dedup, "CHUNK", chunk)
        monkeypatch.setattr(span_dedup, "RANGE", size)
        assert Counter(span_dedup.dedup_spans(docs.repartition(2)).collect()) == whole


def test_long_passages_leave_later_documents(docs, texts):
    kept = {r.doc_id: r.text for r in span_dedup.dedup_spans(docs).collect()}
    inside = [i for i in range(len(texts)) if texts[i] and "\nafter" in texts[i]][0]
    passage = texts[inside + 1]
    assert passage.split()[5:60] == kept[inside].split()[8:63] and not set(passage.split()[20:40]) <= set((kept[inside + 1] or "").split())
    assert kept[inside + 2].startswith("other start.") and len(kept[inside + 2].split()) < 20


def test_passages_within_a_long_sentence_leave(spark):
    rng = random.Random(41)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs, passages = [], []
    for k in range(30):
        passage = [word() for _ in range(51 + k % 10)]
        passages.append(passage)
        for n in (0, 1 + k, 40):
            docs.append((len(docs), " ".join([*(word() for _ in range(n)), *passage, *(word() for _ in range(k % 7))])))
    got = {r.doc_id: r for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        kept = set(got[i].text.split())
        left = sum(w in kept for w in passages[i // 3])
        assert got[i].text == t if i % 3 == 0 else got[i].n_removed >= 3 and left <= 24


def test_sentences_cover_their_text():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["ab", "c", " ", "  ", ". ", "!\n", "\n\n", "?", "long word run "]) for _ in range(rng.randint(0, 60)))
        units = list(span_dedup.sentences(t))
        assert [w for *_, ws in units for w in ws] == t.split()
        assert all(a[1] <= b[0] for a, b in zip(units, units[1:], strict=False)) and (not units or units[-1][1] <= len(t))


# Mixing


def mix_model(rows, most=3):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return sizes, target


def test_mix(docs, empty):
    rows = rows_of(docs)
    sizes, target = mix_model(rows)
    got = source_mix.mix(docs, scales=(0, 1)).collect()
    again = source_mix.mix(docs.repartition(5)).collect()
    assert Counter(got) == Counter(again)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        largest = max(len(WORD.findall(t or "")) for _, t, own in rows if own == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
        if sizes[s]:
            epochs = int(target[s] // sizes[s])
            assert all(r.taken in (epochs * r.size, (epochs + 1) * r.size) for r in got if r.source == s)
    assert source_mix.mix(empty).count() == 0


def test_mix_prefers_weight(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'one two three four' as text", "cast(id % 2 as string) as source", "if(id % 4 < 2, 10.0, 1.0) as w")
    got = {r.heavy: r.n for r in source_mix.mix(df, F.col("w")).join(df.select("doc_id", "w"), "doc_id").where("source = '1' and taken > 4 or source = '0' and taken > 4").groupBy((F.col("w") > 5).alias("heavy")).agg(F.count("*").alias("n")).collect()}
    assert got[True] > 1.2 * got.get(False, 0)


def test_mix_of_light_weights_and_ties(spark):
    """Half of the rows at the floor of the weights, and a third of all with one id: all in the order of the model."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "repeat('w ', cast(if(id % 3 = 0, 4, 1 + id % 7) as int)) as text", "if(id % 2 = 0, 'a', 'b') as source", "case when id % 3 = 0 then 1.0 when id % 4 < 2 then 0.0 else 0.7 end as w").repartition(7)
    rows = [(r.doc_id, r.source, r.size, r.taken, r.target, r.source_size) for r in source_mix.mix(df, F.col("w")).collect()]
    weights = {r.doc_id: max(r.w, 1e-6) for r in df.where("doc_id is not null").collect()}
    assert Counter((i, s, n) for i, s, n, *_ in rows) == Counter((r.doc_id, r.source, len(r.text.split())) for r in df.collect())

    def key(i):
        u = (int(hashlib.md5((str(i) if i is not None else "").encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        return math.log(-math.log(u)) - math.log(weights.get(i, 1.0))

    assert len({key(i) for i, *_ in rows}) == 4001
    for source in "ab":
        own = [r for r in rows if r[1] == source]
        epochs = int(own[0][4] // own[0][5])
        left, want = own[0][4] - epochs * own[0][5], Counter()
        for i, n in sorted(((i, n) for i, _, n, *_ in own), key=lambda x: (key(x[0]), x[1])):
            want[i, n * (epochs + (n / 2 <= left))] += 1
            left -= n
        assert Counter((r[0], r[3]) for r in own) == want
    heavy = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'w w w' as text", "if(id % 3 = 0, 'a', 'b') as source")
    sums = {r.source: r for r in source_mix.mix(heavy).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()}
    assert all(abs(r.n - r.t) <= 2 for r in sums.values())


def test_no_bin_of_the_mix_is_hot(spark):
    """Half of the weights at 0.1: with the digits of a table of this size no bin is far above the median."""
    df = spark.range(100_000).withColumn("w", F.expr("if(id % 2 = 0, 0.1, 0.9)"))
    z = F.log(-F.log(source_mix.draw(F.col("id")))) - F.log("w")
    sizes = [r["count"] for r in df.select(z.alias("_z")).groupBy(source_mix.bin_of(source_mix.SCALES[0])).count().collect()]
    assert max(sizes) < 100_000 / 1000 and df.select(z.alias("z")).distinct().count() == 100_000


# Token counts


def test_token_counts(docs, empty, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r, in [(r,) for r in token_counts.count_tokens(docs, path).collect()]:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert token_counts.count_tokens(empty, path).count() == 0
    count = token_counts.Counter(path)
    rng = random.Random(9)
    parts = ["the ", "Straße", "  ", "\n\n", "'ll", "2024", "!?", "<|endoftext|>", "<|endo", "漢字", "हिन्दी", "😀", "\x1c", "\u00a0", "\u0558", "aaaaaaaaaaaa", "\u200b", "ſ"]
    for _ in range(800):
        t = "".join(rng.choice(parts) for _ in range(25))
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    long_run = "ab" * 30_000
    assert count(long_run) == len(library.encode(long_run).ids)


# Quality rules


def rules_model(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {k + i for ks in at.values() if len(ks) > 1 for k in ks for i in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def ratio_model(rows, good, buckets):
    import xxhash

    def h64(x, seed=42):
        return xxhash.xxh64_intdigest(x, seed)

    def grams(t):
        h = [h64(w.encode()) for w in WORD.findall(t or "")]
        two = [h64(b.to_bytes(8, "little"), h64(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:], strict=False)]
        return [(x - (1 << 64) if x >> 63 else x) % buckets for x in [*h, *two]]

    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    r, g = sum(raw.values()), sum(target.values())

    def score(t):
        found = grams(t)
        ratio = [round((math.log((target[b] + 1) / (g + buckets)) - math.log((raw[b] + 1) / (r + buckets))) * 1e6) if g else 0 for b in found]
        return sum(ratio) / len(ratio) / 1e6 if ratio else 0.0

    return score


def test_quality_rules(spark, docs, empty, texts):
    trusted = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "doc_id long")
    score = ratio_model(rows_of(docs), {1, 2, 5}, 512)
    for r in quality_rules.quality_rules(docs, trusted, buckets=512).collect():
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_model(t)
            assert abs(r.score - score(t)) < 1e-5 and r.kept == (not r.base_failed and r.score >= -0.06)
    assert quality_rules.quality_rules(empty, trusted).count() == 0
    plan = quality_rules.quality_rules(docs, trusted).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("monotonically_increasing_id")
    ids = spark.range(3000).selectExpr("if(id = 5, null, id) as _id")
    likely = {r._id for r in quality_rules.with_likely(ids, ids.where("_id % 3 = 0")).where("_likely").collect()}
    assert {i for i in range(0, 3000, 3)} <= likely and None not in likely and len(likely) < 1020
    alone = quality_rules.quality_rules(docs, trusted.where("false"), buckets=64)
    assert alone.where("score <> 0").count() == 0 and alone.where("kept = base_failed").count() == 0


# SimHash


def fingerprint_model(t, width=4):
    import xxhash

    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    grams = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked_model(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


@pytest.mark.parametrize(("segments", "together"), [(3, 1), (5, 2)])
def test_simhash(docs, empty, texts, segments, together):
    got = [r for r in simhash_dedup.near_duplicates(docs, segments=segments, together=together).collect()]
    prints = [fingerprint_model(t) for t in texts]
    roots = linked_model(prints)
    least = {}
    for i, r in enumerate(roots):
        if i != 7:
            least[r] = min(least.get(r, i), i)
    for r in got:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == least[roots[r.doc_id]]
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert kept.where("doc_id is null").count() == (roots[7] not in least)


def test_links_are_complete(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(8):
            y = x
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    signed = [simhash_dedup._signed(x) for x in sorted(fps)]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    for how in ({"segments": 3, "together": 1}, {"segments": 6, "together": 3}):
        pairs = [tuple(r) for r in simhash_dedup.links(df, **how).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    with pytest.raises(ValueError):
        simhash_dedup.choices(4, 2, 4)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components(edges.where("false"), "a", "b").count() == 0


# URLs


def judge_model(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = m[1].translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h is not None and (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    best = max(fits) if fits else None
    return host, m[2], best and best[3], best[4] if best else "allow"


def test_url_filter(spark):
    rng = random.Random(8)
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.com", "b.a.example.com", "example.net", "net", "xexample.com", "org", "", "a..com", "com."]
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/en/?x#y", "ftp://a.com?x=/en/", "x://y://com/en/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['/en/', '/de/', '/', '', '/en/7/8', '/de/8'])}{rng.choice(['', '?q', '#f', 'ü'])}" for _ in range(400)]
    rules = [*url_filter.RULES, ("allow", "a.example.com", "/"), ("block", "b.a.example.com", "/de/8"), ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", None, "/")]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, "http://com/en/", "x"), (3, urls[3], "x")], "page_id long, url string, host string").repartition(6)
    got = url_filter.apply_rules(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else "http://com/en/"
        assert (r.host, r.path, r.rule, r.verdict) == judge_model(url, rules)
    # General rules, by the operator and by its own SQL.
    import duckdb

    more = [("block", "com", "/en/abcdefghijkl"), ("allow", "example.com", "/en/"), ("allow", "com", "/en/abcdefg"), ("block", "a.example.com", "/"), ("allow", "le.com", "/en/x"), ("block", "com", "/en/abc")]
    paths = ["/en/abcdefghijklm", "/en/abcdefghi", "/en/abcd", "/en/", "/de/", "/en/x"]
    urls = [f"http://{h}{p}" for h in ("com", "x.com", "example.com", "a.example.com", "b.a.example.com", "le.com") for p in paths]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {tuple(r) for r in url_filter.apply_rules(frame, spark.createDataFrame(more, "verdict string, host string, path string")).collect()}
    assert got == {(k, *judge_model(u, more)) for k, u in enumerate(urls)}
    con = duckdb.connect()
    con.execute("create table pages as select unnest(range(len(u))) as page_id, unnest(u) as url from (select ?::varchar[] as u)", [urls])
    values = ", ".join(str(x) for x in more)
    sql = re.sub(r"values \(.*\)\n", f"values {values}\n", url_filter.ORACLE)
    assert {tuple(r) for r in con.execute(f"select page_id, host, path, rule, verdict from ({sql})").fetchall()} == got
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_filter.apply_rules(pages, none).where("verdict <> 'allow'").count() == 0
    assert url_filter.apply_rules(pages.where("false"), none).count() == 0


# Benchmark items


def test_decontamination(spark, docs, empty):
    rng = random.Random(12)
    items = [prose(rng, 40).replace("\n", " ") for _ in range(12)]
    edited = items[2].split()
    for k in range(3, len(edited), 6):
        edited[k] = "changed"
    del edited[20]
    planted = {1000: "lead. " + items[0] + " tail", 1001: items[1].upper(), 1002: "so " + " ".join(edited) + " on", 1003: items[3][: len(items[3]) // 4], 1004: items[4] + "\n" + items[5], 1005: None, 1006: ""}
    own = spark.createDataFrame(list(planted.items()) + [(1000, planted[1000]), (None, items[6])], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").union(own)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, None), (51, ""), (52, "alpha beta"), (0, items[0])], "item_id long, text string")
    for how in ({}, {"block_items": 3}):
        got = decontamination.contaminations(all_, bench, **how).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(1000, 0): 4, (1001, 1): 1, (1002, 2): 1, (1004, 4): 1, (1004, 5): 1, (None, 6): 1})
    assert all(r.score == 1.0 for r in got if r.item_id in (0, 1, 4, 5, 6)) and all(0.5 <= r.score < 1 for r in got if r.item_id == 2)
    odd = all_.selectExpr("*", "1 as _id", "'x' as _text")
    clean = odd.where(decontamination.is_clean(odd, bench))
    assert clean.columns == odd.columns and clean.count() == all_.count() - 6
    assert decontamination.contaminations(empty, bench).count() == 0 and decontamination.contaminations(docs, bench.where("false")).count() == 0


def test_edited_copies_are_found_beside_exact_ones(spark):
    rng = random.Random(31)
    items = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(12, 60))) for _ in range(12)]
    docs, want = [], set()
    for k, item in enumerate(items):
        w = item.split()
        edits = [w, *([("changed" if j % n == n - 1 else x) for j, x in enumerate(w)] for n in (3, 4, 5, 6)), " put ".join(w).split(), [x for j, x in enumerate(w) if j % 3]]
        for e in edits:
            want.add((len(docs), k))
            docs.append((len(docs), "lead " + " ".join(e) + " tail"))
        docs.append((len(docs), " ".join(sorted(w)) + " tail"))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()} == want
    assert docs.where(decontamination.is_clean(docs, bench)).count() == docs.count() - len(want)


def best_shares(words, items):
    numbers = {}
    number = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64)
    text = number(words)
    return {k: decontamination.align(number(x), text)[0] / (2 * len(x)) for k, x in enumerate(items)}


@pytest.mark.parametrize("most", [decontamination.PLACED, 40])
def test_no_pair_is_lost_before_the_alignment(spark, monkeypatch, most):
    """Short items of few words, of which half share a template: all pairs of texts and items, aligned whole."""
    monkeypatch.setattr(decontamination, "PLACED", most)
    rng = random.Random(32)
    template = [rng.choice("abcdefghijkl") for _ in range(9)]
    items = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 16))] for _ in range(60)]
    items += [[*template, *(f"{rng.choice('qrstuvw')}{rng.randrange(9)}" for _ in range(rng.randint(3, 14)))] for _ in range(60)]
    texts = [[rng.choice("abcdefghijklmnopqxyz") for _ in range(rng.randint(1, 90))] for _ in range(150)]
    texts += [[*texts[k][:20], *(w if rng.random() < 0.75 else "changed" for w in items[rng.randrange(120)]), *texts[k][20:]] for k in range(100)]
    want = {}
    for d, words in enumerate(texts):
        want |= {(d, k): s for k, s in best_shares(words, items).items() if s >= 0.5}
    block = decontamination.Block.of(list(enumerate(items)), 2)
    for d in range(len(texts)):
        assert {k: s for k, s, *_ in decontamination.hits(block, " ".join(texts[d]), 0.5)} == {k: s for (own, k), s in want.items() if own == d}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminations(docs, bench).collect()}
    assert {k: r.score for k, r in got.items()} == want and len(want) > 300
    for (d, k), r in got.items():
        assert r.passage.split() == texts[d][r.first_word : r.end_word]
        assert best_shares(r.passage.split(), [items[k]])[0] == r.score


def test_many_templated_items_take_bounded_steps(monkeypatch):
    """A template of most of every item, many times in a text: seeds are placed some at a time, and codes must fit."""
    monkeypatch.setattr(decontamination, "PLACED", 5000)
    items = [["name", "the", "capital", "city", "of", "this", "land", f"x{k}"] for k in range(3000)]
    block = decontamination.Block.of(list(enumerate(items)), 2)
    numbers = block.numbers((items[7] + ["and"]) * 200)
    parts = list(block.placed(numbers, 0.5))
    assert max(len(o) for o, _ in parts) <= 5000 and len(np.unique(np.concatenate([o for o, _ in parts]))) == 3000
    assert sorted(k for k, *_ in decontamination.hits(block, " ".join(items[7]), 0.5)) == list(range(3000))
    with pytest.raises(ValueError, match="do not fit"):
        decontamination.Block.of([(0, [f"w{k}" for k in range(40_000)])], 5)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()


# Repeated bytes


def bytes_model(rows, n=200):
    seen = Counter(t[k : k + n] for t in rows for k in range(len(t) - n + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = True
        out.append(gone)
    return out


def test_suffix_dedup(docs, empty, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t, _ in rows_of(docs)]
    want = defaultdict(list)
    for (i, t), gone in zip(rows, bytes_model([t for _, t in rows]), strict=True):
        want[i].append((len(t), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    got = defaultdict(list)
    for r in suffix_dedup.dedup_bytes(docs).collect():
        got[r.doc_id].append((r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(r.kept).hexdigest()))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert sum(x[1] for v in want.values() for x in v) > 10_000
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_repeats_at_every_distance_and_in_large_groups(spark):
    rng = random.Random(6)
    core = "".join(rng.choice("abcdefgh ") for _ in range(230))
    letters = "abcdefgh "

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    texts = [noise(rng.randint(0, 90)) + core[rng.randint(0, 25) : 230 - rng.randint(0, 25)] + noise(rng.randint(0, 90)) for _ in range(90)]
    texts += ["a" * 199, "b" * 201, "c" * 1000, "ab" * 300, core, core[1:]]
    want = {i: int(g.sum()) for i, g in enumerate(bytes_model([t.encode() for t in texts]))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: sum(s["end"] - s["start"] for s in r.spans) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == want and sum(1 for v in want.values() if v) > 60


def test_any_chunks_of_anchors_agree(spark, monkeypatch):
    """Long texts cut into pieces, chunks of few anchors and many ranges, a line in every text: as by brute force."""
    rng = random.Random(16)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = noise(60), noise(420)
    texts = [noise(rng.randint(0, 300)) + line + noise(rng.randint(0, 300)) for _ in range(150)]
    texts += [noise(700) + passage[k : k + 150 + 40 * k] + noise(700) for k in range(12)] + [passage[:199], passage[:200], noise(5000)]
    texts += [texts[3], texts[3] + "x", texts[-1][2000:2600]]
    want = {i: int(g.sum()) for i, g in enumerate(bytes_model([t.encode() for t in texts]))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for anchors, chunk, size in ((suffix_dedup.ANCHORS, suffix_dedup.CHUNK, suffix_dedup.RANGE), (1, 100, 50), (500, 1000, 1 << 30)):
        monkeypatch.setattr(suffix_dedup, "ANCHORS", anchors)
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        monkeypatch.setattr(suffix_dedup, "RANGE", size)
        got = {r.doc_id: sum(s["end"] - s["start"] for s in r.spans) for r in suffix_dedup.dedup_bytes(df).collect()}
        assert got == want and sum(1 for v in want.values() if v) > 10


def test_loser_tree_merges_and_knows_shared_prefixes():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        found = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))), b"", k, j) for j in range(200)]
        parts = [sorted(found[j::k]) for j in range(k)]
        runs = []
        for part in parts:
            before, out = b"", []
            for s, *rest in part:
                out.append((suffix_dedup.shared(before, s, 0), s, *rest))
                before = s
            runs.append(iter(out))
        merged = list(suffix_dedup.LoserTree(runs))
        assert [m[1] for m in merged] == sorted(s for s, *_ in found)
        for a, b in zip(merged, merged[1:], strict=False):
            assert b[0] == suffix_dedup.shared(a[1], b[1], 0)


# Classifier


def test_classifier(spark, docs, empty, texts):
    rng = random.Random(3)
    good = [(i, prose(rng, rng.randint(20, 120)), 1) for i in range(1000, 1300)]
    bad = [(i, " ".join(w + rng.choice("#$%&") * 3 for w in prose(rng, rng.randint(20, 120)).split()), 0) for i in range(2000, 2200)]
    own = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    all_ = docs.select("doc_id", "text").union(own.select("doc_id", "text"))
    labels = own.select("doc_id", "quality").union(spark.createDataFrame([(1000, 0), (None, 1), (1, None)], "doc_id long, quality int"))
    got = quality_classifier.classify(all_, labels)
    rows = got.collect()
    assert len(rows) == all_.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = {i: q for i, _, q in good + bad}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 50 and sum(r.predicted == known[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {tuple(r) for r in quality_classifier.classify(all_.repartition(2), labels.repartition(5)).collect()} == {tuple(r) for r in rows}
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    alone = quality_classifier.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in alone}) == 1
    assert {r.score for r in quality_classifier.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0
    assert len(quality_classifier.train(all_, labels, most_rows=40).rules) >= 1


def statistics_model(t):
    import regex

    t, n = t or "", len(t or "")
    w = WORD.findall(t)
    lines = t.split("\n")
    share = lambda kind: len(regex.findall(kind, t)) / n if n else 0.0
    return {
        "n_chars": n, "n_words": len(w), "word_len": sum(map(len, w)) / len(w) if w else 0.0, "distinct_words": len(set(w)) / len(w) if w else 0.0,
        "lines": len(lines) / n if n else 0.0, "distinct_lines": len(set(lines)) / len(lines), "upper": share(r"\p{Lu}"), "lower": share(r"\p{Ll}"), "digits": share("[0-9]"),
        "symbols": share(r"[#*$%&|<>@^~=+_{}\\]"), "stops": share("[.,;:]"), "cries": share("[!?]"), "other": share(r"[^\p{L}0-9\x09-\x0D\x20.,;:!?'\"-]"),
        "short_words": len([x for x in re.findall(r"[^\x09-\x0D\x20]+", t) if len(x) <= 3]) / len(w) if w else 0.0,
    }


def test_statistics_and_compiled_rules(spark, docs, texts):
    """The statistics by plain Python, and the compiled column by the rules themselves."""
    names = list(quality_classifier.statistics(F.lit("")))
    rows = quality_classifier.described(docs.select("doc_id", "text"), "text").select("_keep.doc_id", *names).collect()
    for r in rows:
        if r.doc_id is not None:
            want = statistics_model(texts[r.doc_id])
            assert all(abs(r[n] - want[n]) < 1e-9 for n in names), (r.doc_id, {n: (r[n], want[n]) for n in names})
    rng = np.random.default_rng(6)
    x = np.array([[r[n] for n in names] for r in rows], float)
    rules = tuple(quality_classifier.Rule(tuple((n, bool(rng.integers(2)), float(x[rng.integers(len(x)), names.index(n)])) for n in rng.choice(names, rng.integers(1, 4), replace=False).tolist()), float(rng.normal())) for _ in range(40))
    model = quality_classifier.Model(0.3, rules)
    total = 0.3 + sum(r.weight * r.holds(names, x) for r in rules)
    got = quality_classifier.scored(docs.select("doc_id", "text"), model).select("_keep.doc_id", "_score").collect()
    assert np.allclose(sorted(r._score for r in got), sorted(1 / (1 + np.exp(-total))), atol=1e-12)
    for part in (r.parts for r in rules):
        held = np.array([all((row[n] <= cut) == below for n, below, cut in part) for row in rows])
        assert (quality_classifier.Rule(part).holds(names, x) == held).all()


def test_training_rows_are_bounded_by_ids(spark):
    """Ids that come again and again add no rows to those fitted on."""
    docs = spark.range(4000).selectExpr("id % 40 as doc_id", "concat('word ', id % 40) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    found = []
    original = quality_classifier.fit
    quality_classifier.fit = lambda x, y, names: found.append(len(y)) or original(x, y, names)
    try:
        quality_classifier.train(docs, labels)
    finally:
        quality_classifier.fit = original
    assert found and found[0] <= 40


# Secrets


def test_secret_bases(docs, empty):
    span = lambda text: secret_scan.joined(secret_scan.scan(text)[0])
    assert span("password = 'hunter2hunter2'") == "assign:0:26"
    assert span("PassWD:short") == "" and span("toKen=secret=abcdefghijkl") == "assign:0:25"
    assert span("api_key=abcdefghijkl apikey:'0123456789abcdef'") == "assign:0:20,assign:21:45,hex:29:45"
    assert span("é AKIAABCDEFGHIJKLMN x") == "access:2:20" and span("AKIAABC") == ""
    assert span("\u212aKEY api\u212aey=abcdefghijkl") == "" and span("pa\u017f\u017fword=abcdefghijkl") == ""
    assert span("0123456789abcde") == "" and span("x0123456789abcdef0g") == "hex:1:18"
    got = secret_scan.scan_secrets(docs)
    assert got.count() == docs.count() and secret_scan.scan_secrets(empty).count() == 0
    assert secret_scan.redact_secrets(docs).columns == docs.columns


def test_secret_layers():
    import base64
    import gzip
    import zlib
    from urllib.parse import quote

    secret = "password=correcthorsebattery"
    plain = lambda t: secret_scan.joined(secret_scan.scan(t)[1])
    b64 = base64.b64encode(b"config " + secret.encode()).decode()
    assert plain(f"see {b64} end") == f"assign:4:{4 + len(b64)}"
    twice = base64.b64encode(b64.encode()).decode()
    assert plain(f"see {twice} end") == f"assign:4:{4 + len(twice)}"
    for squeeze in (gzip.compress, zlib.compress):
        z = base64.b64encode(squeeze(b"some text before " + secret.encode())).decode()
        assert plain(f"a {z}") == f"assign:2:{2 + len(z)}"
    url = quote(secret, safe="")
    assert plain(f"u {url}") == f"assign:2:{2 + len(url)}"
    all_percent = "".join(f"%{b:02X}" for b in secret.encode())
    assert plain(f"ü {all_percent} t") == f"assign:2:{2 + len(all_percent)}"
    unicode_ = "".join(f"\\u{ord(c):04x}" for c in secret)
    assert plain(f"{unicode_}!") == f"assign:0:{len(unicode_)}"
    mixed = base64.b64encode(unicode_.encode()).decode()
    assert plain(mixed) == f"assign:0:{len(mixed)}"
    for clean in ("plain words only", "%zz %41", "a" * 300, base64.b64encode(bytes(range(256))).decode(), "%25" * 50, "\\ud800\\u0041", "AAAA" * 100):
        secret_scan.scan(clean)
        assert plain(clean) in ("", plain(clean)) and not secret_scan.scan(clean)[0] or "a" * 16 in clean
    assert secret_scan.redacted(f"x {secret} y 0123456789abcdef0") == "x [SECRET] y [SECRET]"
    assert secret_scan.redacted(None) is None and secret_scan.redacted("fine") == "fine"


def test_secrets_below_every_layer(monkeypatch):
    import base64
    import gzip
    import zlib

    secret = "password=correcthorsebattery"
    plain = lambda t: secret_scan.joined(secret_scan.scan(t)[1])
    coded = lambda data: base64.b64encode(data).decode()
    for data in (b"some words\n" * 1_700_000 + secret.encode(), ("x" + "é" * 9_000_000 + " " + secret).encode()):
        run = coded(zlib.compress(data, 9))
        assert f"assign:2:{2 + len(run)}" in plain(f"a {run} b").split(",")  # runs of hex digits come up in it too
    run = coded(gzip.compress(b"first member ") + gzip.compress(secret.encode()))
    assert plain(f"a {run} b") == f"assign:2:{2 + len(run)}"
    deep = secret.encode()
    for _ in range(40):
        deep = gzip.compress(deep, mtime=0)
    run = coded(deep)
    assert plain(f"a {run} b") == f"assign:2:{2 + len(run)}"
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + secret + " tail"
    for data in (text.encode(), gzip.compress(text.encode())):
        for width in (64, 76):
            for gap in ("\n", "\r\n", "\n  ", "\\n"):
                lines = coded(data)
                wrapped = gap.join(lines[k : k + width] for k in range(0, len(lines), width))
                for before, after in (("", ""), ("see\n", "\nthe end"), ("data:", " end")):
                    got = secret_scan.scan(before + wrapped + after)[1]
                    assert any(k == 0 and s >= len(before) and e <= len(before) + len(wrapped) and e - s > 200 for s, k, e in got), (width, gap, before)
                    assert secret not in secret_scan.redacted(before + wrapped + after)
    monkeypatch.setattr(secret_scan, "MOST_INFLATED", 1 << 20)
    run = coded(zlib.compress(b"some words\n" * 200_000 + secret.encode(), 9))
    assert f"partial:2:{2 + len(run)}" in plain(f"a {run} b").split(",") and secret_scan.redacted(f"a {run} b") == "a [SECRET] b"
