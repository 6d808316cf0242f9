"""Periodic runs, online packing and tokenizer alignment against brute force, on odd and on real rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintlake.llm import alignment, periodic, queries, windows
from lintlake.llm.bytesets import strings

BYTES, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark, sf, odd):
    """Real documents, and odd ones behind them."""
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return real.union(odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000000", "text")).repartition(3).persist()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# -- 11: periodic runs


def runs_by_hand(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(rows, exponent=4, least=6):
    codes, _, first = periodic.word_numbers(*strings([" ".join(w) for w in rows]))
    matches, at = periodic.lag_counts(codes, first, exponent)
    for r, w in enumerate(rows):
        assert matches[at[r] + 1 : at[r + 1]].tolist() == [sum(a == b for a, b in zip(w, w[q:], strict=False)) for q in range(1, len(w) // exponent + 1)]
    return [periodic.runs(codes[first[r] : first[r + 1]], matches[at[r] : at[r + 1]], exponent, least) for r in range(len(rows))]


@pytest.mark.parametrize("bar", [None, 2.0, 1e9])
def test_runs_match_brute_force(monkeypatch, bar):
    """With the usual bar between frequent and rare words, all words frequent, and all rare."""
    if bar:
        monkeypatch.setattr(periodic, "frequent", lambda n: np.full(len(n), bar))
    rng = random.Random(3)
    for _ in range(60):
        rows = []
        for _ in range(8):
            w = [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 8, 26])]) for _ in range(rng.randint(0, 120))]
            for _ in range(rng.randint(0, 3)):
                if w:
                    a, p = rng.randrange(len(w)), rng.randint(1, 12)
                    for i in range(a + p, min(len(w), a + p + rng.randint(1, 60))):
                        w[i] = w[i - p]
            if rng.random() < 0.3:  # runs of runs
                w = (w[: rng.randint(1, 4)] * 5 + ["z"] * rng.randint(0, 2)) * 6
            rows.append(w)
        assert runs_of(rows) == [runs_by_hand(w) for w in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.integers(2, 5), st.integers(1, 9))
def test_runs_of_two_words(rows, exponent, least):
    assert runs_of(rows, exponent, least) == [runs_by_hand(w, exponent, least) for w in rows]


def test_one_word_over_and_over_is_scanned_once(monkeypatch):
    scans = []
    real = periodic.islands
    monkeypatch.setattr(periodic, "islands", lambda codes, q, need: scans.append(q) or real(codes, q, need))
    codes, _, first = periodic.word_numbers(*strings(["a " * 50_000 + "b c " * 30_000]))
    matches, _ = periodic.lag_counts(codes, first, 4)
    assert periodic.runs(codes, matches, 4, 6) == [(0, 50_000, 1), (50_000, 60_000, 2)]
    assert scans == [1, 2]


def test_periodic_query_matches_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic(spark, str(tmp_path)).collect() if r["doc_id"] != 1000008}
    planted = 0
    for doc_id, text in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc_id == 1000008 or len(w) > 1500:
            continue
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found, gone = runs_by_hand(w), set()
        for s, length, q in found:
            gone |= set(range(s + q, s + length))
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert planted > 10


def test_periodic_frame(odd, none):
    got = periodic.collapse_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == odd.count()
    assert {r["doc_id"]: r["collapsed"] for r in got.collect()}[3] == ""
    assert periodic.collapse_runs(none).collect() == []


# -- 12: online packing


def check_packing(rows, ids, size):
    """Every id in one piece, sequences without gaps and no longer than ``size``; the lengths of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in [*by_doc.values(), *by_seq.values()]:
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert {k: sum(v[-1]) for k, v in by_doc.items()} == {k: len(v) for k, v in ids.items()}
    lengths = [sum(v[-1]) for v in by_seq.values()]
    assert max(lengths, default=0) <= size
    return lengths


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_of_documents(docs, parts):
    """In one round and in two of merging: whole windows, or lengths that are powers of two."""
    once = docs.where("doc_id <> 1000008")
    library = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in once.collect()}
    rows = windows.pack_online(once.repartition(parts), WORDS).collect()
    lengths = check_packing(rows, ids, 4096)
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths) and sum(n < 4096 for n in lengths) <= 12
    assert len(rows) < 1.5 * sum(-(-len(x) // 4096) for x in ids.values())  # few texts are cut that need not be


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5))
def test_windows(sizes, most):
    w, full, at = windows.Windows(16, most), [], 0
    for k, n in enumerate(sizes):
        full += w.put(windows.Piece(k, 0, np.arange(at, at + n), n))
        assert len(w.open) <= most and all(x.used < 16 for x in w.open)
        at += n
    assert all(x.used == 16 for x in full)
    rest = list(w.rest())
    assert all(x.used == 16 for x in rest[:-1])
    last = list(windows.powers(rest.pop())) if rest and rest[-1].used < 16 else []
    assert len({x.used for x in last}) == len(last)
    every = [i for x in [*full, *rest, *last] for p in x.pieces for i in p.ids.tolist()]
    assert sorted(every) == list(range(at))


def test_words_are_encoded_as_the_library_does():
    coder, rng = windows.WordCodec(WORDS), random.Random(4)
    letters = ["a", "B", "'s", "é", "é", "Σ", "ς", "İ", "1", "½", "日", "🎉", " ", " ", "\n", "\t", "\x0b", " ", "　", "\x85", "\x1c", "́", "-", "<|endof", "ǅ", "ﬁ", "'", '"', "H\u0331", "h\u0331", "E\u0301", "don't", "'RE", "'ll", ".", "12", "_", "\x7f", "\x00", "T"]
    for special in ([], ["<|endoftext|>", "<|startoftext|>"]):
        for _ in range(20):
            texts = ["".join(rng.choice(letters + special) for _ in range(rng.randint(0, 60))) for _ in range(150)]
            ids, first = coder.encode(*strings(texts))
            for k, text in enumerate(texts):
                assert ids[first[k] : first[k + 1]].tolist() == coder.library.encode(text, add_special_tokens=False).ids, text


def test_packing_frame(odd, none):
    got = windows.pack_online(odd, WORDS)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(r["doc_id"] for r in got.collect() if r["start"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    assert windows.pack_online(none, WORDS).collect() == []
    with pytest.raises(ValueError, match="not those of its stretches"):
        windows.WordCodec(BYTES)


# -- 13: alignment


def by_hand(text, library, model):
    """Ids of A and B, groups as lists of both, and links, from byte ranges alone."""
    if not text:
        return None
    a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(letters.values()))}
    said_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
    said_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in (model.id_to_piece(i) for i in b)]
    if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in said]).tolist() for said in (said_a, said_b))
    both, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for end in both:
        x = [k for k in range(i, len(a)) if ends_a[k] <= end]
        y = [k for k in range(j, len(b)) if ends_b[k] <= end]
        groups.append((x, y))
        i, j = x[-1] + 1, y[-1] + 1
    begin_a, begin_b = [0, *ends_a], [0, *ends_b]
    links = [(a[p], b[q]) for x, y in groups for p in x for q in y if max(begin_a[p], begin_b[q]) < min(ends_a[p], ends_b[q])]
    return a, b, ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups), len(groups), links


def test_alignment_matches_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100_000)
    strange = ["<|endoftext|> a <s> </s> <unk>", "▁x a", " b  c\n\td", "\x00 ﬁ ①", "日本語 🎉👍🏽", "é́ e"]
    some = docs.where("doc_id <> 1000008 AND (text IS NULL OR length(text) < 3000)").union(spark.createDataFrame([(2000000 + k, t) for k, t in enumerate(strange)], "doc_id long, text string"))
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {i: by_hand(t, library, model) for i, t in some.collect()}
    count = Counter(x for w in want.values() if w for x in w[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    plain = {r["doc_id"]: r for r in alignment.align_documents(some, BYTES, PIECES).collect()}
    assert plain.keys() == want.keys() and sum(w is None for w in want.values()) >= 3
    for i, w in want.items():
        r = plain[i]
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, n_groups, links = w
        assert tuple(r)[1:] == (len(a), len(b), n_groups, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), groups)
    digests = alignment.align_documents(some, BYTES, PIECES, digest=True).collect()
    assert all(r["groups"] == (sha(plain[r["doc_id"]]["groups"]) if plain[r["doc_id"]]["groups"] else "") for r in digests)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_components(n, edges):
    edges = [(u % n, v % n) for u, v in edges]
    found = alignment.components(n, np.array([u for u, _ in edges], np.int64), np.array([v for _, v in edges], np.int64))
    least = list(range(n))
    for _ in range(n):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    assert found.tolist() == least


def test_alignment_frame(odd, none):
    got = alignment.align_documents(odd, BYTES, PIECES)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in odd.collect())
    assert alignment.align_documents(none, BYTES, PIECES).collect() == []


def test_contexts_are_answered_in_little_memory():
    import tracemalloc

    from lintlake.llm import exchange, repeats

    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 1 << 40, 300_000, dtype=np.uint64))  # an anchor each: the sort has nothing to do
    size = np.full(len(key), 60)
    body = rng.integers(97, 120, int(size.sum())).astype(np.uint8)
    value = exchange.pack(0, **exchange.pack_sorted(key), who=np.arange(len(key)), size=size.astype(np.int16), body=body)
    tracemalloc.start()
    try:
        (got,) = repeats.reply_contexts(50)([exchange.unpack(value)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12 * len(body)  # about 20 times as much where all strings are held at once
    got = exchange.unpack(got)
    assert got["runs"].tolist() == [1] * len(key) and got["size"].tolist() == [11] * len(key)
    assert got["who"].tolist() == list(range(len(key)))


def test_a_range_of_contexts_is_answered_in_parts_of_its_keys(monkeypatch):
    """What ten blocks sent to one range is gone through some megabytes at a time, and parts change no answer."""
    import tracemalloc

    from lintlake.llm import exchange, repeats

    rng = np.random.default_rng(5)
    values = []
    for block in range(10):
        key = np.sort(rng.integers(0, 1 << 62, 20000).astype(np.uint64) if block % 2 == 0 else values[-1][0])
        size = rng.integers(60, 91, len(key)).astype(np.int16)
        body = rng.integers(97, 123, int(size.sum())).astype(np.uint8)
        values.append((key, size, body, rng.integers(0, 1000, len(key))))
    sent = [exchange.pack(0, **exchange.pack_sorted(k), who=w, size=s, body=b) for k, s, b, w in values]
    total = sum(len(b) for _, _, b, _ in values)

    def answered():
        got = [exchange.unpack(x) for x in repeats.reply_contexts(50)([exchange.unpack(x) for x in sent])]
        return [{k: v.tolist() for k, v in g.items() if k != "top"} for g in got]

    monkeypatch.setattr(repeats, "_PART", 1 << 20)
    monkeypatch.setattr(repeats, "_SLICE", 1 << 18)
    tracemalloc.start()
    try:
        repeats.reply_contexts(50)([exchange.unpack(x) for x in sent])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    few = answered()
    monkeypatch.setattr(repeats, "_PART", 1 << 40)
    assert few == answered()
    assert peak < 3.4 * total  # 3.8 times as much where all are compared at once
