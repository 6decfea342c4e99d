"""Periodic runs, sentence pieces and token alignment against brute force and the libraries themselves."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.llm import alignment, periodic, pieces, units

SCHEMA = "doc_id long, text string, ids string, runs string, links string, h long, n int, collapsed int"
ODD = [
    "a", "b", " ", "  ", "\n", "\t", "▁", "<s>", "</s>", "<0x0A>", "é", "é", " ", "　", "\u0085", "日本", "😀", "\x00", "\x1c", ".", ",",
    "'s", "123", "<|endoftext|>", "ﬁ", "①", "​", "the", "�", "word ", " ok",
]


def odd_texts(seed, n, most=14):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(most))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(odd_texts(7, 300)))
    out += [(1000, None), (1001, ""), (1002, " "), (None, None), (None, "a b a b a b a b a b"), (5, "again"), (5, "again"), (-3, "x " * 30)]
    out += [(2000, "the cat sat on the mat, " * 300), (2001, "y" * 5000), (2002, "\n ".join(odd_texts(9, 250)))]
    return out


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(w, min_length=6, min_exponent=4):
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(min_length, min_exponent * q):
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(seed):
    rnd, w = random.Random(seed), []
    while len(w) < 60:
        w += [rnd.choice("ab") for _ in range(rnd.randrange(1, 6))] * rnd.randrange(1, 7) if rnd.random() < 0.5 else [rnd.choice("abc")]
    return w[: rnd.randrange(1, 60)]


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (5, 3)])
def test_runs_against_brute_force(bounds):
    for seed in range(400):
        w = periodic_words(seed)
        want = brute_runs(w, *bounds)
        assert periodic.runs(w, *bounds) == want
        codes = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
        found = []
        for s, e in periodic.stretches(codes, np.zeros(len(w), np.int64), *bounds):
            found += [(s + x, y, q) for x, y, q in periodic.runs(w[s:e], *bounds)]
        assert found == want


def test_runs_end_where_texts_end():
    codes = np.array([1, 2] * 12, np.uint64)
    assert periodic.stretches(codes, np.repeat([0, 1], 12), 6, 4) == [(0, 12), (12, 24)]


def plain_words(text):
    return (text or "").encode().split()


def edited(doc_id, text):
    w = plain_words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w if h % 10 else [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_digest(spark, rows):
    rows = rows[:200] + rows[300:308] + [(k, " ".join(periodic_words(k))) for k in range(400, 600)] + [(700, "a b " * 500)]

    def want(i, t):
        w = edited(i, t)
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        drop = {k for s, length, q in found for k in range(s + q, s + length)}
        text = b" ".join(x for k, x in enumerate(w) if k not in drop)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        return (i, len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(text).hexdigest())

    got = periodic.digest(periodic.detect(periodic.repeated(table(spark, rows)))).collect()
    assert Counter(map(tuple, got)) == Counter(want(i, t) for i, t in rows)
    assert sum(r.n_runs for r in got) > 100


def test_detect_gives_runs_and_texts(spark):
    (r,) = periodic.detect(table(spark, [(1, "x  la la la la la la\ny")])).collect()
    assert [tuple(x) for x in r.runs] == [(1, 6, 1)] and r.collapsed == "x la y"
    assert periodic.digest(periodic.detect(periodic.repeated(table(spark, [])))).count() == 0


# --- sentence pieces ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.mark.parametrize("size", [30, units.SLICE])
def test_pieces_and_spans_are_the_librarys(library, monkeypatch, size):
    monkeypatch.setattr(units, "slices", lambda texts, most=size, f=units.slices: f(texts, most))
    own = pieces.pieces(pieces.MODEL)
    texts = [*odd_texts(1, 2000), *odd_texts(2, 20, 400), None, ""]
    for t, (ids, begin, end) in zip(texts, pieces.encoded_batch(texts, own)):
        t = t or ""
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        proto = library.encode(t, return_type="proto")
        n = len(t.encode())
        assert list(zip(begin.tolist(), end.tolist())) == [(0, 0), *((p.begin, p.end) for p in proto.pieces), (n, n)]


def test_memory_that_is_full_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(units, "UNITS", 5)
    own = pieces.Pieces.__new__(pieces.Pieces)
    own.__dict__ = dict(pieces.pieces(pieces.MODEL).__dict__)
    own.memory = units.Memory(own._encode)
    for t in odd_texts(3, 60, 40):
        assert pieces.encoded_batch([t], own)[0][0].tolist() == library.encode(t, add_bos=True, add_eos=True)


@pytest.mark.parametrize("squeeze", [False, True])
def test_normalisation_through_a_compiled_map(squeeze):
    from sentencepiece import SentencePieceNormalizer

    lib = SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
    spec = {n: v for k, value, _ in pieces.fields(lib.serialized_model_proto()) if k == 3 for n, v, _ in pieces.fields(value)}
    own = pieces.Normaliser(spec[2], squeeze)
    for t in odd_texts(4, 1500) + ["", "  ", "ｶﾞ ①  ﬃ", "ẹ́x"]:
        want, places = lib.normalize(t, with_offsets=True)
        data, source = own(t.encode())
        assert data.decode() == want
        # The library counts characters on both sides; where nothing is left, no piece asks for a place.
        firsts = [k for k, c in enumerate(data) if c & 0xC0 != 0x80]
        assert not data or [len(t.encode()[: source[k]].decode()) for k in [*firsts, len(data)]] == list(places)


def test_encoded_and_decoded_tables(spark, rows, library):
    found = pieces.encoded(table(spark, rows)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, tuple(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)
    assert all(len(r.begins) == len(r.ends) == len(r.ids) for r in found)
    back = pieces.decoded(pieces.encoded(table(spark, rows))).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, library.decode(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)
    empty = table(spark, [])
    assert pieces.encoded(empty).count() == pieces.digest(empty).count() == 0


def test_piece_digest(spark, rows, library):
    def want(i, t):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        return i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()

    got = pieces.digest(table(spark, rows)).drop("spans_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want(i, t) for i, t in rows)


# --- token alignment ---------------------------------------------------------------------------


def test_product_against_dense():
    rnd = np.random.default_rng(1)
    for shape in [(5, 7, 4), (1, 1, 1), (0, 3, 2), (6, 0, 2), (8, 9, 30)]:
        a, b = rnd.random(shape[:2]) < 0.4, rnd.random(shape[1:]) < 0.4

        def sparse(x):
            return alignment.Rows(np.append(0, np.cumsum(x.sum(1))).astype(np.int64), np.nonzero(x)[1], x.shape[1])

        i, j, v = alignment.product(sparse(a), sparse(b))
        full = np.zeros((shape[0], shape[2]), int)
        full[i, j] = v
        assert (full == a.astype(int) @ b.astype(int)).all() and (v > 0).all()
        t = sparse(a).transposed()
        assert (t.start == sparse(a.T).start).all() and (t.columns == sparse(a.T).columns).all()


@pytest.fixture(scope="module")
def both(library):
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    tok = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    tok.encode_special_tokens = True
    byte = {}
    for k in range(256):
        pre = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL)).pre_tokenizer
        if k < 128:
            byte[pre.pre_tokenize_str(chr(k))[0][0]] = k
        elif k >= 192:
            continue
    for c in (chr(x) for x in range(128, 0x800)):
        for shown, k in zip(pre.pre_tokenize_str(c)[0][0], c.encode()):
            byte[shown] = k
    for c in ("ࠀ", "က", " ", "　", "䀀", "倀", "怀", "瀀", "耀", "退", "ꀀ", "뀀", "쀀", "퀀", "", "", "😀", "\U00040000", "\U00080000", "\U000c0000", "\U00100000"):
        for shown, k in zip(pre.pre_tokenize_str(c)[0][0], c.encode()):
            byte[shown] = k
    assert ByteLevel

    def split(text):
        """Tokens (id, bytes) of both, or None."""
        if not text:
            return None
        a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in library.encode(text):
            p = library.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in x) == raw for x in (a, b)) else None

    return split


def ended(tokens):
    at, out = 0, []
    for i, t in tokens:
        at += len(t)
        out.append((i, at - len(t), at))
    return out


def test_token_alignment(spark, rows, both):
    parts = [(i, both(t)) for i, t in rows]
    assert sum(p is None for _, p in parts) > 5
    links = []
    for _, p in parts:
        a, b = map(ended, p or ([], []))
        at = {e: j for j, _, e in b}
        links.append([(i, at[e]) for i, _, e in a if e in at])
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    want = []
    for (i, p), own in zip(parts, links):
        a, b = map(ended, p or ([], []))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, s = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(k) for k, _, x in side if s < x <= e) for side in (a, b)))
            s = e
        digest = sha256(";".join(groups).encode()).hexdigest() if p else ""
        want.append((i, len(a), len(b), len(ends), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), digest))
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # Long texts make the brute force above slow, not the operator.
    assert Counter(map(tuple, alignment.counted(table(spark, rows)).select(*cols).collect())) == Counter(want)


def test_text_of_several_slices(spark, both, library):
    text = "the cat sat on the mat, " * (units.SLICE // 10) + "end\n  "
    assert len(list(units.slices([text]))) > 2
    a, b = map(ended, both(text))
    ends = {e for _, _, e in a} & {e for _, _, e in b}
    (r,) = alignment.counted(table(spark, [(1, text)])).collect()
    assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(ends), len(ends))
    (r,) = alignment.aligned(table(spark, [(1, text)]), overlaps=False).collect()
    assert (r.a_ids, r.b_ends) == ([i for i, _, _ in a], [e for _, _, e in b])
    assert r.group_a == np.searchsorted([e for _, _, e in a], sorted(ends), side="right").tolist()
    (r,) = pieces.encoded(table(spark, [(1, text)])).collect()
    proto = library.encode(text, return_type="proto")
    assert r.ids[1:-1] == [p.id for p in proto.pieces] and r.ends[1:-1] == [p.end for p in proto.pieces]


def test_aligned_table(spark, both):
    texts = [t for t in odd_texts(11, 60, 30)] + [None, "", "a▁b"]
    own = alignment.aligner(alignment.BYTE_LEVEL, pieces.MODEL)
    assert own.numbers <= 4 * (sum(map(len, own.a.bytes)) + sum(map(len, own.b.bytes)))
    out = {r.doc_id: r for r in alignment.aligned(table(spark, list(enumerate(texts))), shared=True).collect()}
    for i, t in enumerate(texts):
        p = both(t)
        a, b = map(ended, p or ([], []))
        r = out[i]
        assert (r.a_ids, r.a_ends, r.b_ids, r.b_ends) == ([k for k, _, _ in a], [e for _, _, e in a], [k for k, _, _ in b], [e for _, _, e in b])
        over = [(x, y, min(ea, eb) - max(sa, sb)) for x, (_, sa, ea) in enumerate(a) for y, (_, sb, eb) in enumerate(b) if min(ea, eb) > max(sa, sb)]
        assert list(zip(r.overlap_a, r.overlap_b, r.overlap_bytes)) == over
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        group = lambda e: sum(x < e for x in ends)
        assert list(zip(r.shared_a, r.shared_b)) == [(x, y) for x, (_, _, ea) in enumerate(a) for y, (_, _, eb) in enumerate(b) if group(ea) == group(eb)]
        assert r.group_a == [sum(x <= e for _, _, x in a) for e in ends] and r.group_b == [sum(x <= e for _, _, x in b) for e in ends]


def test_empty_alignment(spark):
    assert alignment.counted(table(spark, [])).count() == alignment.aligned(table(spark, [])).count() == 0
    assert [tuple(r)[1:7] for r in alignment.counted(table(spark, [(1, None), (1, "")])).collect()] == [(0, 0, 0, 0, 0, "")] * 2
