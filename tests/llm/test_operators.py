"""Each operator against a brute-force version over the edge cases of conftest, and over no rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import cuckoo, decontam, langid, licenses, linededup, packing, quality, sharding, shared, simhash, tokenout, tokens, vptree, warc

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(rows):
    return Counter(map(tuple, rows))


def test_quality(docs, rows, empty):
    got = quality.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert bag(got) == bag(want)
    assert quality.assess(empty).count() == 0


def test_langid(spark, empty):
    en, fr = "the quick brown fox and the lazy dog sleep", "le renard brun et le chien qui dort dans la maison"
    rows = [(k, (en if k % 2 else fr) + f" {k}", "en" if k % 2 else "fr") for k in range(200)] + [(300, None, "en"), (301, "123 !", "fr"), (302, "le chien", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "fr") for k in range(200))
    assert got[300].lang_pred == got[301].lang_pred == "und" and got[300].score == 0 and not got[301].accepted
    assert got[302].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(empty).labels == [] and langid.predict(empty, model).count() == 0


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(rows):
    """Rows that share a number are one document; no number counts as the largest."""
    number = lambda i: linededup.LAST if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 10:
                holders[line_key(x)].add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if min(holders.get(line_key(x), {number(i)})) == number(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_line_dedup(docs, rows, empty):
    got = linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert bag(got) == bag(kept_lines(rows))
    assert linededup.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(spark, docs):
    refs = shared.materialize(linededup.references(docs), "refs")
    first = linededup.LineIndex.empty(spark).insert(refs.where("doc % 2 = 0"))
    both = first.insert(refs.where("doc % 2 = 1"))
    back = both.delete(refs.where("doc % 2 = 1").select("doc"))
    state = lambda x: bag(x.counts.select("hi", "lo", "n", "least").collect())
    assert state(back) == state(first) != state(both)
    assert state(back.insert(refs.where("doc % 2 = 1"))) == state(both)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 1 << 63, (2, 20_000), np.uint64)
    f = cuckoo.CuckooFilter.holding(hi, lo)
    assert f.contains(hi, lo).all() and f.contains(lo, hi).mean() < 0.01
    f.delete(hi[:5000], lo[:5000])
    f = cuckoo.CuckooFilter.load(f.dump())
    assert f.contains(hi[5000:], lo[5000:]).all() and f.contains(hi[:5000], lo[:5000]).mean() < 0.01


@pytest.mark.parametrize("limit", [1 << 30, 2000, 300])
def test_sharding(docs, rows, empty, limit):
    got = sharding.assign(docs.drop("shard"), limit=limit, also=("text",)).collect()
    assert bag((r.doc_id, r.doc_bytes) for r in got) == bag((i, len((t or "").encode())) for i, t in rows)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.doc_bytes
    for r in got:
        code = format(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16), "060b")
        assert code.startswith(r.shard[:60]) and r.shard_bytes == sums[r.shard]
        assert r.shard_bytes <= limit or r.shard_docs == 1 or len({x.doc_bytes for x in got if x.shard == r.shard}) == 1
        near = sum(v for s, v in sums.items() if r.shard and s.startswith(r.shard[:-1]))
        assert not r.shard or near > limit or ":" in r.shard
    assert sharding.assign(empty, limit=limit).count() == 0


def least_roots(fps, radius):
    up = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            best = min(up[y] for y in fps if (x ^ y).bit_count() <= radius)
            if best != up[x]:
                up[x], changed = best, True
    return up


def test_simhash(docs, rows, empty):
    fps = []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    up = least_roots({f for _, f in fps}, 4)
    least = {}
    for i, f in fps:
        if i is not None:
            least[up[f]] = min(i, least.get(up[f], i))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert bag(got) == bag((i, format(f, "016x"), least.get(up[f])) for i, f in fps)
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_point_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    p = np.unique(base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 4
    for _ in range(len(p)):
        label = np.where(near, label[None, :], len(p)).min(1)
    assert (vptree.components(p, 4) == label).all()
    tree = vptree.Tree(p, radius=6)
    found = {(q, i) for leaf, who in tree.visits(p[:50]) for q in who.tolist() for i in tree.members[leaf].tolist() if int(p[q] ^ p[i]).bit_count() <= 6}
    assert found == set(map(tuple, np.argwhere(np.bitwise_count(p[:50, None] ^ p[None, :]) <= 6).tolist())) and len(tree.members) > 3


def near_graph(fps, radius):
    """Roots of distinct fps by comparing all with all, in blocks."""
    label = np.arange(len(fps))
    ends = [np.argwhere(np.bitwise_count(fps[a : a + 500, None] ^ fps[None, :]) <= radius) + [[a, 0]] for a in range(0, len(fps), 500)]
    ends = np.concatenate(ends)
    while True:
        low = label.copy()
        np.minimum.at(low, ends[:, 0], label[ends[:, 1]])
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("radius,shard", [(4, 2000), (4, 1 << 20), (2, 3000), (7, 4000)])
def test_links_of_twenty_thousand(spark, monkeypatch, radius, shard):
    rng = np.random.default_rng(radius)
    flip = lambda x, n: x ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, len(x))).astype(np.uint64), 0)
    base = rng.integers(0, 1 << 63, 15_000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 15_000).astype(np.uint64)
    dense = flip(np.repeat(base[:1], 3000), 2)  # a ball, and pairs about the radius
    fps = np.unique(np.concatenate([base, dense, flip(base[:2500], radius), flip(base[2500:4000], radius + 1)]))
    built = []
    tree = vptree.Tree
    monkeypatch.setattr(vptree, "Tree", lambda *a, **k: built.append(tree(*a, **k)) or built[-1])
    points = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long").repartition(3)
    stars = simhash.links(points, len(fps), radius, shard, sample=4000).collect()
    assert len(built) == radius // 2 + 1 and all(len(t.members) > 3 for t in built)
    where = {int(x): i for i, x in enumerate(fps.view(np.int64).tolist())}
    label = np.arange(len(fps))
    a, b = (np.array([where[r[c]] for r in stars]) for c in (0, 1))
    assert (vptree.spread(label, a, b) == near_graph(fps, radius)).all()


def test_decontam(spark, monkeypatch, docs, rows, empty):
    items = [(1, "hay stack that is long enough to find"), (2, "a needle IN a hay stack, that is long enough to find!"), (3, None), (4, ""), (5, "short item"), (5, "mit license"), (None, rows[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add("" if i is None else str(i))
    want = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    for slice_bytes in (decontam.SLICE_BYTES, 1500):  # one pass, and several
        monkeypatch.setattr(decontam, "SLICE_BYTES", slice_bytes)
        got = decontam.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.concat_ws(",", "items"), "contaminated").collect()
        assert bag(got) == bag(want) and any(x[5] for x in want)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def ids_of(text, end):
    return np.array(tokens.encoder(tokens.default_path()).whole.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(docs, rows, empty):
    got = packing.pack(docs, group=20).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.copy].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = bag((i, len(x), tuple(zlib.crc32(x[a : a + 2048].tobytes()) for a in range(0, len(x), 2048))) for i, x in ((i, ids_of(t, 1)) for i, t in rows))
    have = bag((i, p[0].doc_tokens, tuple(r.ids_crc32 for r in sorted(p, key=lambda r: r.start))) for (i, _), p in pieces.items())
    # rows that share a number may fall into one batch or two; their pieces are the same
    assert sum(r.length for r in got) == sum(n * c for (_, n, _), c in want.items())
    assert {k for k in want if want[k] == 1 and sum(x[0] == k[0] for x in want) == 1} <= set(have)
    filled = packing.sequences(packing.pack(docs, payload="ids")).collect()
    assert sum(len(r.ids) for r in filled) == 2 * sum(r.length for r in got)
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    sizes = np.array([2048, 1500, 1000, 900, 548, 400, 148])
    where, offset = packing.first_fit_decreasing(sizes, np.arange(7), 2048)
    assert where.tolist() == [0, 1, 2, 2, 1, 3, 2] and offset.tolist() == [0, 0, 0, 1000, 1500, 0, 1900]


def test_token_ids(spark, docs, rows, empty):
    folder = shared.fresh_path(spark, "t")
    manifest, shards = tokenout.write(docs, folder, shard_bytes=20_000)
    got = sorted(tokenout.read(manifest, shards, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows if i is not None)) + [None]
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((i, len(x), zlib.crc32(x.tobytes())) for i, x in ((i, ids_of(t, 2)) for i, t in rows))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    manifest, shards = tokenout.write(empty, folder + "e")
    assert tokenout.read(manifest, shards, folder + "e").count() == 0


def test_ids_by_word_are_ids_of_the_text():
    enc = tokens.encoder(tokens.default_path())
    texts = ["foo's isn't 12.5 I'LL  <|endoftext|> a<|endoftext|>b. naïve x\x1cy İ ǅ H̱ ﬁ. «a». é.. ", "ŉa. Ĳ ſ ªº", "Σας 日本語。 1½ a.b ...", " "]
    ids, ends = enc.encode([t.encode() for t in texts], 1)
    assert enc.by_word
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == ids_of(t, 1).tolist()


def test_pfor_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = np.where(rng.random(n) < 0.9, rng.integers(0, 300, n), rng.integers(0, 1 << 32, n, np.uint64)).astype(np.uint32)
        blocks = tokenout.encode(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (tokenout.decode(b"".join(blocks), np.array(starts, np.int64)) == ids).all()


def test_licenses(docs, rows, empty):
    got = licenses.scan(docs).collect()
    want = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == bag(want)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got) and all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(empty).count() == 0


def test_license_templates(spark):
    rows = [(k, f"some code {text} more words") for k, (_, text, _) in enumerate(licenses.TEMPLATES)] + [(99, "permission is granted to nobody")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, (label, _, _) in enumerate(licenses.TEMPLATES)) and got[99] == [""]


def test_license_negatives_and_mixtures(spark):
    cut = licenses._MIT.split()
    rows = [
        (0, "permission to deal in the software free of charge is hereby not granted to any person"),
        (1, " ".join(sorted(cut))),  # all words, none in place
        (2, licenses._BSD + licenses._BSD_3 + licenses._BSD_AS_IS),
        (3, licenses._BSD + licenses._BSD_AS_IS),
        (4, licenses._MIT.replace("hereby granted", "granted")),  # a mandatory phrase is broken
        (5, licenses._ISC + " and also " + licenses._MIT + licenses._AS_IS + " some rights reserved"),
        (6, " ".join(w if k % 12 else w + "x" for k, w in enumerate((licenses._ZLIB + " ").split(), 1))),
        (7, "the terms of the gnu general license, apache style, public domain notice"),
        (8, "word " * 500 + licenses._MIT + licenses._AS_IS),
    ]
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[7] == (set(), 0.0) and "mit" not in got[4][0]
    assert got[2][0] == {"bsd", "bsd-3-clause"} and got[3][0] == {"bsd", "bsd-2-clause"}
    assert got[5][0] == {"isc", "mit"} and got[8][0] == {"mit"} and got[5][1] == got[8][1] == 1.0


def test_warc(spark, rows, empty):
    pages = [(i, f"http://x/{i} é" if k % 3 else None, t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    files = []
    for k in range(2):  # the same bytes from other partitions
        folder = shared.fresh_path(spark, "w")
        manifest, shards = warc.write(df.repartition(k + 1), folder, shard_bytes=20_000, roll_bytes=4_000)
        files.append(bag(manifest.select("name", "sha256", "records").collect()))
    assert files[0] == files[1] and len(files[0]) > 2
    number = lambda i: warc.LAST if i is None else i
    first, want = {}, []
    for i, _, t in pages:
        if len((t or "").encode()) >= 100:
            first[t] = min(number(i), first.get(t, warc.LAST))
    seen = set()
    for i, _, t in sorted(pages, key=lambda p: number(p[0])):
        body = (t or "").encode()
        again = t in first and (first[t] != number(i) or t in seen)
        seen.add(t)
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    got = warc.read(manifest, shards, folder).collect()
    assert bag(tuple(r)[:1] + tuple(r)[2:6] for r in got) == bag(want)
    manifest, shards = warc.write(df.limit(0), folder + "e")
    assert warc.read(manifest, shards, folder + "e").count() == 0
