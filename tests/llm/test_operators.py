"""The ten operators against brute force, round trips and held-out accuracy, on odd and on real rows."""

import hashlib
import math
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lintlake.llm import bpe, bytesets, fingerprint, html, jaccard, language, lm, media, packing, quality, repeats, suffixes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# -- 10: BPE


def test_bpe_is_the_library(monkeypatch):
    coder = bpe.Codec(TOKENIZER)
    monkeypatch.setattr(bpe, "LEAF", 64)
    monkeypatch.setattr(bpe, "PIECE", 16)
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefghij ", "aA'st \n\t1", "é€ß aé", "x", " ", "日本 a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 500))) + rng.choice(["", "<|endoftext|>", "\x85\xa0 x"])
        want = coder.library.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert got.tolist() == want
        assert coder.decode(got).decode() == coder.library.decode(want, skip_special_tokens=False)


def test_trees_of_unsplit_text(spark, sf):
    """Joins happen on documents and on every script, and leave the ids that the library gives."""
    coder = bpe.Codec(TOKENIZER)
    library = lambda t: coder.library.encode(t, add_special_tokens=False).ids
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert all(coder.encode(t).tolist() == library(t) for t in texts)
    assert coder.joins[0] > 5
    rng = random.Random(5)
    for letters in ("日本語中文字符", "👍🏽🎉", "abcab", "!?", "ab 日", "\n ", "'l "):
        coder.joins = [0, 0]
        for n in (5000, 20001):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert coder.encode(text).tolist() == library(text), letters
        assert sum(coder.joins) > 0 or letters == "\n ", letters


def test_sums():
    """Each gap that singles, pairs or triples of the counted lengths can fill is filled by one."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        left = rng.integers(0, 3, 40) * (rng.random(40) < 0.3)
        left[0] = 0
        sums = packing.Sums(left)
        have = [k for k in range(40) for _ in range(left[k])]
        for gap in range(1, 40):
            for n, look in ((1, sums.single), (2, sums.pair), (3, sums.triple)):
                can = any(sum(x) == gap for x in itertools.combinations(have, n))
                found = look(gap, left)
                assert bool(found) == can and (not found or (sum(found) == gap and all(found.count(x) <= left[x] for x in found)))


def test_few_sequences(spark, sf):
    """Within two hundredths of the least number of sequences that the tokens could fill."""
    got = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), TOKENIZER, 2048)
    n, tokens = got.selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_bpe_frame(odd, none):
    got = bpe.encode_texts(odd, TOKENIZER).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in got) == sorted((i or 0, t or "") for i, t in rows(odd))
    assert bpe.encode_digests(odd, TOKENIZER).where("doc_id = 3").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(none, TOKENIZER).count() == 0


# -- 2: packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 101, 3000) if seed % 2 else np.minimum(100, rng.geometric(0.05, 3000)), minlength=101)
    made = packing.plan(counts, 100)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += times
    assert used == Counter({k: int(v) for k, v in enumerate(counts) if v})
    n = sum(t for _, t in made)
    assert n <= 1.02 * math.ceil(int((counts * np.arange(101)).sum()) / 100) + 1


def test_pack_frame(odd, none):
    got = packing.pack_documents(odd, TOKENIZER, 256, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for pieces in by.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 256
    assert sum(r["length"] for r in got) == sum(len(bpe.codec(TOKENIZER).encode(t or "")) + 1 for _, t in rows(odd))
    assert packing.pack_documents(none, TOKENIZER, 256).count() == 0


# -- 7: media


def test_media(odd, none, spark, tmp_path):
    got = media.media_digests(odd).collect()
    want = {(i, hashlib.sha256(media.padded(t)[0]).hexdigest(), len((t or "").encode())) for i, t in rows(odd)}
    assert {(r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in got} == want
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert media.media_digests(none).count() == 0
    finished = media.write_archives(odd, f"file://{tmp_path}/m", archive_bytes=2000)
    for table in (finished, ""):
        read = media.read_archives(spark, f"file://{tmp_path}/m", table, range_bytes=500)
        assert read.count() == odd.count() and read.rdd.getNumPartitions() > 20
    named = spark.createDataFrame([("", "a"), (None, "b"), ("a b", "c")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_bytes"]) for r in media.media_digests(named).collect()} == {("", 1), (None, 1), ("a b", 1)}


def test_media_match_brute_force(docs):
    """Sums, lengths and features of real texts, from the payload and an image decoder of a few lines."""
    texts = dict(rows(docs))
    for r in media.media_digests(docs).collect():
        data = (texts[r["doc_id"]] or "").encode()
        whole = data + b" " * (-len(data) % 192 or (0 if data else 192))
        png = media.to_png(whole)
        at = png.index(b"IDAT")
        lines = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
        assert b"".join(lines[k + 1 : k + 193] for k in range(0, len(lines), 193)) == whole
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(whole[-16:]), len(png), hashlib.sha256(png).hexdigest())
        share = Counter(x >> 4 for x in whole)
        mean = sum(whole) / len(whole)
        spread = math.sqrt(sum((x - mean) ** 2 for x in whole) / len(whole))
        bands, m, d = r["feature"].split("-")
        assert bands == "".join(f"{15 * share[k] // len(whole):x}" for k in range(16)) and float(m) == pytest.approx(mean, abs=1e-3) and float(d) == pytest.approx(spread, abs=1e-3)


def test_members_are_read_again_by_offset():
    class Flaky:
        def __init__(self, data, fail):
            self.data, self.at, self.fail = data, 0, fail

        def seek(self, at):
            self.at = at

        def read(self, n):
            if self.fail:
                self.fail -= 1
                raise OSError("lost")
            out = self.data[self.at : self.at + n]
            self.at += n
            return out

    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", b"payload")
        info = z.infolist()[0]
    reader = media.ArchiveReader({"path": "file:/x"})

    class FS:
        def open_input_file(self, name):
            return Flaky(held.getvalue(), 0)

    assert reader.member(FS(), Flaky(held.getvalue(), 1), "x", info.header_offset, 7, info.CRC) == b"payload"
    with pytest.raises(OSError):
        reader.member(FS(), Flaky(held.getvalue(), 0), "x", info.header_offset, 7, info.CRC + 1)


# -- 1 and 3: classifiers


def test_language(docs, odd, none):
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2 AND lang IS NOT NULL")
    got = language.predict(held, model, keep=["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    said = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(odd, model).collect()}
    assert {(3, True), (4, True), (5, True), (10, True), (1, False), (11, False)} <= said
    assert language.predict(none, model).count() == 0
    assert language.predict(odd, language.fit(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = np.where(rng.random(4000) < 0.8, y, 1 - y)  # right in 0.8 of all rows
    logits = np.stack([10.0 * (z == 0), 10.0 * (z == 1)], 1)
    assert abs(1 / (1 + math.exp(-10 / language.temperature(logits, y))) - 0.8) < 0.03


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = "crc32(cast(doc_id as string)) % 5"
    model = quality.fit(docs, labels.where(f"{fold} <> 0"))
    got = quality.score(docs, model).join(labels.where(f"{fold} = 0"), "doc_id").collect()
    assert sum((r["score"] >= quality.CUT) == r["quality"] for r in got) >= 0.93 * len(got)
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(none, model).count() == 0
    assert quality.score(odd, quality.fit(odd, labels.where("false"))).select("score").distinct().collect()[0][0] == 1.0


# -- 4: suffixes and repeats


def naive_order(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    texts = [np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0].astype(np.int16) for _ in range(300)]
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = suffixes.orders(np.concatenate(texts), starts)
    for k, t in enumerate(texts):
        want = naive_order(t.tolist())
        assert (got[starts[k] : starts[k + 1]] - starts[k]).tolist() == want
        assert suffixes.order(t).tolist() == want


def brute_repeats(docs, length):
    first, out = {}, []
    data = [(i if i is not None else -(1 << 63), (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            first[x] = min(first.get(x, i), i)
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 4096])
def test_repeats(docs, odd, none, hot):
    for df in (odd, docs):
        got = repeats.remove_repeats(df, 50, hot=hot, block_bytes=1 << 16).collect()
        have = sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), bytes(r["kept"]), sum(s["end"] - s["begin"] for s in r["spans"])) for r in got)
        assert have == brute_repeats(rows(df), 50)
    assert repeats.remove_repeats(none, 50).count() == 0


def test_many_contexts_of_one_anchor():
    rng = np.random.default_rng(5)
    body = [np.r_[rng.integers(97, 99, 10), np.full(40, 120), rng.integers(97, 99, 10)].astype(np.uint8) for _ in range(60)]
    body = [np.frombuffer(x, np.uint8) for x in {b.tobytes() for b in body}]
    size, who = np.array([60] * len(body)), rng.permutation(len(body))
    got = repeats.least_holders(np.zeros(len(body), np.uint64), size, np.concatenate(body), who, 50)
    first = {}
    for b, w in zip(body, who, strict=True):
        for k in range(11):
            x = b[k : k + 50].tobytes()
            first[x] = min(first.get(x, w), w)
    assert got.tolist() == [first[b[k : k + 50].tobytes()] for b in body for k in range(11)]


# -- 5: language model


def test_lm(docs, odd, none):
    for df, n in ((odd, 3), (docs, 5)):
        train = f"crc32(cast(doc_id as string)) % {n} <> 1"
        from pyspark.sql import functions as F

        got = lm.score_documents(df, F.expr(train), block_bytes=1 << 16).collect()
        have = rows(df)
        tokens = [(i, [*words(t), None]) for i, t in have]
        learned = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % n != 1]
        c = Counter(x for t in learned for x in t)
        total, types = sum(c.values()), len(c)
        want = sorted((i or 0, len(t), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (types + 1))) for x in t), 6)) for i, t in tokens)
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(none, F.lit(True)).count() == 0


def mixed(model, one, two, three, starts, before, last, token):
    """The interpolated probability of a token after two, from counts in Python and the learned weights.

    ``starts`` training documents begin behind two ends (None); a context without an occurrence gives no estimate.
    """
    kind = lambda c: 0 if c == 0 else min(lm.CLASSES - 1, c.bit_length())
    seen_two = starts if before is None and last is None else two[before, last]
    w, u = model.weights[kind(one[last])], model.upper[kind(seen_two)]
    lower = w[1] * one[token] / model.n + w[2] / (len(one) + 1)
    if one[last]:
        lower += w[0] * two[last, token] / one[last]
    return u[1] * lower + (u[0] * three[before, last, token] / seen_two if seen_two else 0)


def test_lm_score_matches_brute_force(docs, monkeypatch):
    """Scores from counts of triples, pairs and words in Python; after any context the probabilities sum to 1."""
    models = []
    rows_of = lm.score_rows
    monkeypatch.setattr(lm, "score_rows", lambda m: models.append(m) or rows_of(m))
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in lm.score_documents(docs, F.expr("crc32(cast(doc_id as string)) % 5 <> 1"), block_bytes=1 << 16).collect()}
    (model,) = models
    tokens = {i: [*words(t), None] for i, t in rows(docs)}
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    grams = lambda t: zip([None, None, *t[:-2]][: len(t)], [None, *t[:-1]], t, strict=True)
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            starts += 1
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
            three.update(grams(t))
    assert (model.n, model.types) == (sum(one.values()), len(one))
    counts = (one, two, three, starts)
    for i, t in tokens.items():
        want = [mixed(model, *counts, *g) for g in grams(t)] if len(t) < 200 else None
        if want:
            assert got[i]["score"] == pytest.approx(sum(map(math.log10, want)), rel=1e-9) and max(want) <= 1
        assert got[i]["score"] <= 0
    first = next(t for i, t in tokens.items() if len(t) > 9 and zlib.crc32(str(i).encode()) % 5 != 1)
    contexts = [(None, None), (None, first[0]), (first[0], first[1]), (first[1], first[0]), ("never", first[0]), (first[0], "never"), ("never", "seen")]
    for before, last in contexts:
        assert sum(mixed(model, *counts, before, last, x) for x in [*one, "unknown"]) == pytest.approx(1, abs=1e-9), (before, last)
    assert np.allclose(model.weights.sum(1), 1) and np.allclose(model.upper.sum(1), 1)


def test_lm_without_training(docs):
    from pyspark.sql import functions as F

    got = lm.score_documents(docs.limit(20), F.lit(False), block_bytes=1 << 16).collect()
    assert len(got) == 20 and all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_documents_that_occur_twice_stand_out(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(300)]
    texts += texts[:60]
    from pyspark.sql import functions as F

    got = lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True), block_bytes=1 << 16).collect()
    each = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in got}
    twice, once = [each[k] for k in range(60)], sorted(each[k] for k in range(60, 300))
    assert sum(x > once[int(0.9 * len(once))] for x in twice) > 0.9 * 60


def test_mixture_sums_to_one_over_a_vocabulary():
    none = np.zeros(0, np.int64), np.zeros(0)
    model = lm.Model(10, 3, lm.mixture(*none, (0.4, 0.5, 0.1)), lm.mixture(*none, (0.3, 0.7)))
    triple, pair, single, four = np.array([1, 1, 0]), np.array([2, 1, 1]), np.array([5, 3, 2]), np.array([4, 4, 4])
    p = model.probability(triple, np.array([2, 2, 2]), pair, four, single)
    assert abs(p.sum() + 0.7 * model.weights[3][2] * model.floor - 1) < 1e-9  # the floor also serves one unknown token


# -- 6: Jaccard join


def brute_components(docs, n, share):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and share[1] * len(x & y) >= share[0] * len(x | y):
                p, q = sorted((top(ids[a]), top(ids[b])))
                root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("n", "share"), [(3, (90, 100)), (5, (80, 100)), (2, (50, 100))])
def test_jaccard(docs, odd, none, n, share):
    some = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for df in (some, docs):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df, n, share).collect()}
        assert got == brute_components(rows(df), n, share)
    assert jaccard.similar_components(odd, n, share).count() == odd.count()
    assert jaccard.similar_components(none, n, share).count() == 0


@pytest.mark.parametrize("sides", [False, True])
def test_search(sides):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, (6, 80)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(80) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, 1 << 40, 80).astype(np.uint64), base[k % 6])) for k in range(120)]
    side = rng.integers(0, 2, 120) if sides else None
    got = jaccard.search(sets, (80, 100), side)
    root = list(range(120))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(120):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o) and (side is None or side[a] != side[b]):
                root[top(a)] = top(b)
    pairs = {(a, b) for a in range(120) for b in range(a)}
    assert {(a, b) for a, b in pairs if got[a] == got[b]} == {(a, b) for a, b in pairs if top(a) == top(b)}


def test_cut_clusters(spark, monkeypatch):
    """Clusters of many chunks keep every link: near copies in one group, chains, and outsiders."""
    monkeypatch.setattr(jaccard, "CLUSTER", 300)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(40)]
    texts = []
    for _ in range(60):  # copies with an edit or two
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for start in range(0, 120, 2):  # a chain: each like the next
        texts.append(" ".join(f"c{k}" for k in range(start, start + 40)))
    texts += [" ".join([*base[:20], *(f"x{j}y{k}" for k in range(20))]) for j in range(20)]
    rows_ = list(enumerate(texts))
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(df, 1, (80, 100)).collect()}
    bags = [set(t.split()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            o = len(bags[a] & bags[b])
            if 100 * o >= 80 * len(bags[a] | bags[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert got == {k: top(k) for k in range(len(texts))}


def test_linked_groups_match_all_pairs():
    rng = np.random.default_rng(8)
    share = (80, 100)
    base = rng.integers(0, 1 << 60, (5, 300)).astype(np.uint64)
    sets = sorted((np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 1 << 60, 300).astype(np.uint64), base[k % 5])[: rng.integers(200, 300)]) for k in range(90)), key=len)
    maps = [jaccard.bitmap(s) for s in sets]
    n, w = np.array([len(s) for s in sets]), np.array([len(m) for m in maps])
    got = jaccard.linked(n, w, np.cumsum(w) - w, np.concatenate(maps), share)
    group = np.arange(90)
    for a in range(90):
        for b in range(a):
            wide = min(w[a], w[b])
            apart = np.bitwise_count(jaccard.fold(maps[a][None], wide) ^ jaccard.fold(maps[b][None], wide)).sum()
            if jaccard.needed(n[a], share) <= n[b] and apart <= jaccard.differ(n[a] + n[b], share):
                group[group == group[a]] = group[b]
    assert ((got[:, None] == got) == (group[:, None] == group)).all()


# -- 8: wrappers


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div id="main-text"><h2>%s</h2>%s</div><div class="comments"><p>Nice!</p></div><form><input></form><footer>&copy; me</footer></body></html>'


def test_wrapper():
    pages = [PAGE % (f"Title {k}", "".join(f"<p>Text {k} {j} &amp; more</p>" for j in range(k + 1))) for k in range(4)]
    wrapper = html.infer(pages)
    found = html.expression(wrapper)
    assert "<div main-text><h2>#</>(<p>#</>)+</>" in found and "<header>text</>" in found
    assert html.extract(pages[1], html.Choice(wrapper)) == "Title 1 Text 1 0 & more Text 1 1 & more"
    parts = [html.infer(pages[:2]), html.infer(pages[2:])]
    parts[0].merge(parts[1])
    assert html.expression(parts[0]) == found


def test_alignment():
    """Optional and repeated groups, slots and constants, whatever the order of pages."""
    made = ["<div>a</div><ul><li>1<li>2</ul>", "<div>a</div><p>x</p><ul><li>3</ul>", "<div>a</div><p>y</p><h2>q</h2><p>z</p><h2>r</h2>"]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        found = html.expression(html.infer([made[k] for k in order]))
        assert found.count("<div>text</>") == 1 and "(<li>#</>)+" in found and "(<ul>" in found and ")?" in found, found
        assert "((<p>#</>)?(<h2>text</>)?)+" in found


#: Pages of two hosts without article or main, and their texts written out by hand. Nothing but the wrapper tells the texts apart.
PLAIN = '<body><div class="x1"><b>The Daily</b> all the news</div><table><tr><td class="x2"><a href="/a">%s</a><a href="/b">%s</a></td></tr></table><div class="x3"><h1>%s</h1><div class="x4">%s<div class="x5">Read on with us every day</div></div></div><div class="x6">Made in town</div></body>'


def _plain(n, host):
    return [(host * 100 + k, f"http://h{host}.org/{k}", PLAIN % (f"Go {k}", f"Not {k}", f"Head {k} of {host}", f"<p>First {k * 7} words</p><p>Second {k * 3} words and more</p>" + "<p>Third</p>" * (k % 2)), f"Head {k} of {host} First {k * 7} words Second {k * 3} words and more" + " Third" * (k % 2)) for k in range(n)]


def test_wrapper_decides(spark):
    made = _plain(7, 1) + _plain(5, 2)
    inside = [(300 + k, "http://h3.org/x", f'<article><p>News {k}</p><div class="y">Subscribe now for more</div><div class="related-work"><p>Related work {k}</p></div></article>', f"News {k} Related work {k}") for k in range(4)]
    made += inside
    made += [made[0], made[0]]  # repeated rows
    df = spark.createDataFrame([x[:3] + (1, "q") for x in made], "page_id long, url string, html string, _host int, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df).collect())
    assert got == sorted((x[0], x[3], len(x[3])) for x in made)
    alone = [html.extract(x[2]) for x in made]  # without the host's wrapper
    assert all(a != x[3] for a, x in zip(alone, made, strict=True))
    assert html.extract_pages(df.where("false")).collect() == []


def test_extract():
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("<article><h1>A&nbsp;b</h1><p>c<b>d</b>e<p>f<br>g<script>var a='</p>';</script></article><p>out") == "A b cde f g"
    assert html.extract("<p>open <!-- never closed") == "open"
    assert html.extract("<article><aside>no</aside><p>yes</article>") == "yes"
    for tag in ("button", "select", "object", "canvas", "svg", "video", "option"):
        assert html.extract(f"<article><p>one</p><{tag}>Go<p>two</p></article>") == "one two", tag
        assert html.extract(f"<article><p>one</p><{tag}>Go</{tag}><p>two</p></article>") == "one two", tag
    assert html.extract("<article><p>a <math><mi>x</mi></math> b</article>") == "a x b"
    assert html.extract('<article><div class="related-work"><p>Section text</p></div><p>More</p></article>') == "Section text More"
    assert html.extract('<article><p>A long enough text</p><div class="comment-list"><p>Nice!</p></div></article>') == "A long enough text"
    assert html.extract("<form id=all><div><h1>T</h1><p>text</p></div></form>") == "T text"
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.extract("<article>" + "<p>x</p>" * 30000 + "</article>") == " ".join("x" * 30000)


def test_extract_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        parts = [" ".join(html.html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", m[1])]
        assert got[r["page_id"]] == " ".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None), (2, "no url", "<p>x"), (None, "http://h/", "")], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html.extract_pages(odd).collect()) == [("", 0), ("", 0), ("x", 1)]


def test_wrappers_come_from_all_pages(spark):
    """Rare blocks, long pages and pages outside any sample count; the host's template is still left out."""
    page = '<body><section>Same words</section><section class="list">%s</section><div>Text %s</div>%s</body>'
    menu, words = "<a>One</a><a>Two</a>", "Only words here"
    rare = {3: "<h3>Rare head</h3>", 17: "<blockquote>Said once</blockquote>", 55: "<table><tr><td>Cell</table>" + "<p>long</p>" * 2000}
    made = [(k, f"http://h/{k}", page % (words if k == 40 else menu, k, rare.get(k, ""))) for k in range(60)]
    made += [(100 + k, f"http://h/c{k}", made[3][2]) for k in range(20)]  # copies of a page count once
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    said = {3: "Text 3 Rare head", 17: "Text 17 Said once", 40: "Only words here Text 40", 55: "Text 55 Cell" + " long" * 2000}
    assert all(got[k] == said.get(k, f"Text {k}") for k in range(60))
    assert {got[100 + k] for k in range(20)} == {said[3]}


# -- 9: fingerprints


def test_fingerprints(docs, odd, none):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}
    have = sorted(rows(docs))
    for k, (i, t) in enumerate(have):
        t, after = t or "", have[(k + 1) % len(have)][1] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    by = {}
    for i, t in have:
        by.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.1 > mean("near_next")
    odd_rows = fingerprint.fingerprint_documents(odd).collect()
    assert len(odd_rows) == odd.count()
    assert {r["fingerprint"] for r in odd_rows if r["doc_id"] in (3, 4, 5)} == {"0" * 16 * fingerprint.SUBSETS}
    assert fingerprint.fingerprint_documents(none).count() == 0


def test_fingerprints_match_brute_force(docs):
    """The band, the sub-lexicons, the hash of the sorted distinct words and the likeness, one word at a time."""
    mask = (1 << 64) - 1
    code = lambda w: int(bytesets.word_hashes(*bytesets.strings([w]))[0][0])
    mixed = lambda x: int(bytesets.mix(np.array([x & mask], np.uint64))[0])
    bags = {i: {code(w) for w in words(t)} for i, t in rows(docs)}
    n = Counter(w for bag in bags.values() for w in bag)
    total = len(bags)
    band = {w for w, k in n.items() if max(2, fingerprint.LOW * total) <= k <= fingerprint.HIGH * total}
    rate = lambda s: 2 ** -(s // fingerprint.EACH + 2)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs).collect()}

    def own(bag):
        used = sorted(bag & band or bag)
        out = []
        for s in range(fingerprint.SUBSETS):
            seq = [w for w in used if (mixed(w + (s + 1) * 0xA24BAED4963EE407) >> 32) < rate(s) * 2**32]
            h = sum(mixed(w + s) * pow(int(fingerprint._BASE), k + 1, 1 << 64) for k, w in enumerate(seq)) & mask
            out.append(mixed(h) | 1 if seq else 0)
        return out

    ids = sorted(bags)
    some = {i: own(bags[i]) for i in ids[:12]}
    for i, x in some.items():
        assert got[i]["fingerprint"] == "".join(f"{h:016x}" for h in x)
    for a, b in zip(ids[:11], ids[1:12], strict=True):
        pairs = list(zip(some[a], some[b], strict=True))
        blocks = [pairs[k : k + fingerprint.EACH] for k in range(0, fingerprint.SUBSETS, fingerprint.EACH)]
        sparse = [p for block in blocks if sum(map(any, block)) <= 0.75 * fingerprint.EACH for p in block if any(p)]
        either = sparse or [p for p in pairs if any(p)]
        assert got[a]["near_next"] == pytest.approx(sum(x == y for x, y in either) / len(either) if either else 1.0)


def test_long_edited_texts_stay_alike(spark):
    """Texts of thousands of words in the band, half of them replaced, are told from unrelated ones."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(30000)}" for _ in range(9000)) for _ in range(40)]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.1 + mean("near_next")


def test_next_document_across_buckets(docs):
    out = fingerprint.with_next(docs, "doc_id", "text", rows_per_range=7).collect()
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    by = {}
    for r in out:
        by.setdefault(r["_bucket"], []).append(r)
    after = {}
    for group in by.values():
        group.sort(key=lambda r: (r["_extra"], r["id"]))
        after |= {a["id"]: b["id"] for a, b in zip(group, group[1:], strict=False) if not a["_extra"]}
    assert after == {a: b for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


# -- shared parts


def test_words_and_shingles():
    texts = ["A b\tc", "", "one", "x x x x", "Ünï cöde w"]
    buf, starts = bytesets.strings(texts)
    h, row = bytesets.word_hashes(buf, starts)
    assert np.bincount(row, minlength=5).tolist() == [len(words(t)) for t in texts]
    s, r = bytesets.shingles(h, row, 3)
    assert np.bincount(r, minlength=5).tolist() == [1, 0, 1, 1, 1]
    assert bytesets.word_hashes(*bytesets.strings(["ABC"]))[0] == bytesets.word_hashes(*bytesets.strings(["abc"]))[0]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= kept.count(), name
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good, bad = (docs.join(labels.where(f"quality = {q}"), "doc_id").select("doc_id") for q in (1, 0))
    first = corpus_pipeline.quality_filter(spark, docs, sf).select("doc_id").cache()
    assert first.join(good, "doc_id").count() >= 0.95 * good.count()
    assert first.join(bad, "doc_id").count() <= 0.2 * bad.count()
