"""The other operators against brute force, on small tables with nulls, blanks, repeats and clashing columns."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.llm import cover_tree, decontaminate, licenses, line_dedup, mixing, ngram_join, tokens, toxicity
from factline.sources import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, h string, score double, _key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n", "h", 0.5, "k") for i, t in rows], SCHEMA)


def words(seed, n, size=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def edited(ws, seed, share):
    rnd = random.Random(seed)
    return [f"x{rnd.randrange(10**6)}" if rnd.random() < share else w for w in ws]


@pytest.fixture(scope="module")
def rows():
    base = [words(k, 80) for k in range(6)]
    out = [(k, " ".join(w)) for k, w in enumerate(base)]
    for s in range(60):
        out.append((100 + s, " ".join(edited(base[s % 4], s, 0.005 * (s % 12)))))
    long = words(99, 6000)
    out += [(300, " ".join(long)), (301, " ".join(edited(long, 5, 0.02))), (302, "A b C"), (303, "a B c"), (304, "a b"), (305, "one"), (306, "One")]
    out += [(400, None), (401, ""), (402, " \n\t"), (403, " "), (400, None), (302, "A b C"), (302, "another text of that id altogether here"), (None, " ".join(base[0])), (None, None), (-5, " ".join(base[1]))]
    return out


def shingle_set(t):
    w = K_split(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def K_split(t):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall("[^\x20\x09-\x0D]+", low)


def unite(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = unite(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(r, d)) for (d, _), s, r in zip(rows, sets, root)), key=str)


def assert_one_each(kept, rows):
    """Of every group of rows that link one is kept, of the least id; of rows without words one for each id and text."""
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    groups = {}
    for row, s, r in zip(rows, sets, unite(len(rows), links)):
        groups.setdefault(r if s else row, []).append(row)
    assert len(kept) == len(groups)
    for own in groups.values():
        least = min(own, key=lambda x: (x[0] is None, x[0]))[0]
        assert len([x for x in kept if x in own]) == 1
        assert [x[0] for x in kept if x in own] == [least]


def test_near_duplicates_equal_brute_force(spark, rows):
    got = ngram_join.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_near_duplicates_with_split_columns(spark, rows, monkeypatch):
    """Every column in parts of two rows: links across parts are still found."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = ngram_join.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_deduplicate_keeps_one_of_each_group(spark, rows):
    df = table(spark, rows)
    out = ngram_join.deduplicate(df)
    assert out.columns == df.columns
    assert_one_each([(r.doc_id, r.text) for r in out.collect()], rows)
    assert len([r for r in out.collect() if r.doc_id == 302]) == 2


def test_long_copies_among_many_that_share_a_passage(spark):
    """One column of thousands of components, and two rows of 20,000 words with a few edits."""
    long = words(50, 20_000, 10**6)
    rows = [(k, f"one passage that all share {' '.join(words(k, 14, 10**6))}") for k in range(3000)]
    rows += [(9001, " ".join(long)), (9002, " ".join(edited(long, 3, 0.01))), (9003, " ".join(edited(long, 4, 0.3)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
    assert got[9001][1] == got[9002][1] == 9001 and got[9003][1] == 9003
    assert all(got[k] == (15, k) for k in range(3000))


def test_deduplicate_keeps_unlinked_rows_without_ids(spark):
    a, b, c, d = [" ".join(words(700 + k, 40)) for k in range(4)]
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (None, c), (None, None), (None, ""), (None, ""), (9, c), (1, d), (1, None), (1, ""), (1, d)]
    kept = [(r.doc_id, r.text) for r in ngram_join.deduplicate(table(spark, rows)).collect()]
    first = [x for x in kept if x in [(None, a), (None, a + " more")]]
    assert len(first) == 1
    assert sorted(kept, key=str) == sorted([*first, (None, b), (None, None), (None, ""), (9, c), (1, d), (1, None), (1, "")], key=str)


def test_components_of_paths_and_cliques(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + j) for i in range(8) for j in range(8)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.comp for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(range(201)) | set(range(1000, 1008))
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(8)}) == 1 and got[0] != got[1000]


# --- tokens ------------------------------------------------------------------------------------


def test_tokens_make_the_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    more = [*rows, (500, "a<|endoftext|>b <|startoftext|>"), (501, "it's DON'T ΣΑΣ İ é \x1c x"), (502, "y" * 5000)]
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    path = scratch.fresh_path(spark, "test-orc")
    tokens.write(table(spark, more), path, files=3)
    want = {}
    for d, x in more:
        want.setdefault(d, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    got = {}
    for r in tokens.read(spark, path).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    digest = sorted(tokens.digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in digest] == np.concatenate([[0], np.cumsum([r.n_tokens for r in digest])[:-1]]).tolist()
    ids = [r.doc_id for r in digest if r.doc_id is not None]
    assert ids == sorted(ids) and digest[0].doc_id is None
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.ids_crc32 for r in digest)) == sorted(crc(x) for v in want.values() for x in v)
    assert tokens.read(spark, path, [300, 305]).count() == 2


def test_token_memory_starts_anew(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "MEMORY", 3)
    e = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    texts = ["the cat sat on the mat", None, "", "the dog", "a the a the"]
    for _ in range(3):
        flat, n = e.encode(texts, 1)
        want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert flat.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def test_no_tokens(spark):
    path = scratch.fresh_path(spark, "test-orc")
    tokens.write(table(spark, []), path, files=2)
    assert tokens.digest(spark, path).count() == 0


# --- decontamination ---------------------------------------------------------------------------


def test_masks_lose_no_window():
    for missed in itertools.chain([()], itertools.combinations(range(13), 1), itertools.combinations(range(13), 2)):
        assert any(all(o + i not in missed for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(13 - len(m) + 1)), missed


def test_contamination_equals_brute_force(spark):
    items = [(k, " ".join(words(1000 + k, n, 10**6))) for k, n in enumerate([13, 14, 20, 40, 59, 5, 1])] + [(50, ""), (51, None), (None, "a b c")]
    docs = []
    for s in range(120):
        rnd = random.Random(s)
        ws = words(s, rnd.randint(0, 60))
        k, text = items[rnd.randrange(7)]
        part = text.split()
        a = rnd.randrange(len(part))
        part = part[a : a + rnd.randint(1, 40)]
        docs.append((s, " ".join(ws[:20] + edited(part, s, rnd.choice([0, 0, 0.08, 0.15, 0.3])) + ws[20:])))
    docs += [(200, None), (201, ""), (202, items[6][1].upper() + "!"), (7, docs[7][1]), (None, items[3][1])]

    def brute(t):
        w, out = np.array([zlib.crc32(x) for x in K.alnum_words(t)]), []
        for k, x in items:
            v = np.array([zlib.crc32(y) for y in K.alnum_words(x)])
            if k is None or not len(v):
                continue
            size, miss = (13, 2) if len(v) >= 13 else (len(v), 0)
            if any((w[i : i + size] == v[j : j + size]).sum() >= size - miss for i in range(len(w) - size + 1) for j in range(len(v) - size + 1)):
                out.append(k)
        return out

    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, h string")
    got = decontaminate.contamination(table(spark, docs), bench).collect()
    want = sorted(((d, ",".join(map(str, brute(t)))) for d, t in docs), key=str)
    assert sorted(((r.doc_id, r.item_ids) for r in got), key=str) == want
    df = table(spark, docs)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, x in want if not x), key=str)
    assert decontaminate.contamination(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


# --- licences ----------------------------------------------------------------------------------


def test_automaton_gives_matching_statistics():
    a = licenses.Automaton((("x", "a b c a b d"), ("y", "b c a a")), {"a b": "p"})
    factors = {tuple(t[i:j]) for t in ("a b c a b d".split(), "b c a a".split(), "a b".split()) for i in range(len(t)) for j in range(i, len(t) + 1)}
    for text in itertools.product("abcd", repeat=6):
        codes = [a.vocab[w.encode()] for w in text]
        state = length = 0
        for i, c in enumerate(codes):
            while state and c not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if c in a.next[state]:
                state, length = a.next[state][c], length + 1
            assert length == max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in factors)
        _, phrases = a.scan(codes, 0)
        assert phrases == [(0, i) for i in range(5) if text[i : i + 2] == ("a", "b")]


def test_licences(spark):
    apache = dict(reversed(licenses.TEMPLATES))["apache-2.0"]
    texts = [
        "x Licensed under CC BY-NC 4.0. All rights reserved; GNU General Public License, all  rights\nRESERVED", None, "", "cc cc by by", "cc. (BY) général public license",
        f"foo bar {apache.upper()} baz", "Released under the MIT License.", "permission is hereby granted", "the of and to the license " * 3000, "all rights reserved " * 5000,
    ]
    rows = [*enumerate(texts), (0, texts[0]), (None, "all rights reserved")]
    df = licenses.scan(table(spark, rows).withColumn("licence", F.lit(1)))
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(r.licence)

    def brute(t):
        w = [x.decode() for x in K.alnum_words(t)]
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))

    for i, t in rows:
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[5][0].labels == "apache-2.0" and got[5][0].score == 1 and got[6][0].labels == "mit"
    assert got[7][0].labels == "" and len(got[0]) == 2 and got[0][0].labels == "cc-by,cc-by-nc,gpl,reserved"
    assert licenses.scan(table(spark, [])).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def toxic_rows():
    rows, labels = [], []
    for i in range(400):
        ws = words(i, 30)
        bad = i % 4 == 0
        if bad:
            ws[10:12] = ["blarg" + random.Random(i).choice(["en", "ish", "ung"]), "zonk"]
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (None, "you idiot"), (3, rows[3][1]), (1002, "word " * 50_000), (1003, "You are a blargish zonk!")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(by[i].predicted == y for i, _, y in labels if by[i].held_out)
    assert by[1000].predicted == by[1001].predicted == by[1002].predicted == 0 and by[1003].predicted == 1


def test_clauses_not_words():
    lexer = toxicity.Lexer(toxicity.SEED)
    event = lambda t: dict(zip(toxicity.EVENTS, toxicity.events(t, lexer)[0]))
    assert event("you are an idiot")["plain"] > 0 and event("you idiot")["targeted"] == 1
    assert event("you are not an idiot")["plain"] == 0 and event("you are not an idiot")["negated"] > 0
    assert event("he said that idiot left")["reported"] > 0
    assert event("i will kill you")["threat"] == 1 and event("they kill time")["threat"] == 0
    assert event(None)["clauses"] == 0 == event("")["clauses"]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(table(spark, [(1, "you stupid idiot, you worthless scum"), (2, "fine")]), none).count() == 2
    assert toxicity.toxicity(table(spark, []), none).count() == 0


def brute_cover(words, template):
    """The largest share of a template that matches of MIN_MATCH words or more, in order on both sides, cover, gaps at most MAX_GAP."""
    same = [(i, j) for i in range(len(words)) for j in range(len(template)) if words[i] == template[j]]
    run = {}
    for i, j in same:
        run[i, j] = run.get((i - 1, j - 1), 0) + 1
    spans = [(i + 1 - n, i + 1, j + 1 - n, j + 1) for (i, j), n in run.items() if n >= licenses.MIN_MATCH and (i + 1, j + 1) not in run]
    best = 0
    cover = {}
    for a, b, s, e in sorted(spans):
        before = [n for (x, t), n in cover.items() if x <= a <= x + licenses.MAX_GAP and t <= s <= t + licenses.MAX_GAP]
        cover[b, e] = max(cover.get((b, e), 0), max(before, default=0) + b - a)
        best = max(best, cover[b, e])
    return best / len(template)


@pytest.mark.parametrize("label,text", licenses.LICENCES)
def test_whole_licences_in_edited_texts(label, text):
    a = licenses.Automaton()
    which = [k for k, (x, _) in enumerate(licenses.TEMPLATES) if x == label and licenses.TEMPLATES[k][1] == text][0]
    template = K.alnum_words(text)
    rnd = random.Random(len(text))
    for share in (0, 0.02, 0.06, 0.15, 0.3):
        words = [b"zz" if rnd.random() < share else w for w in template]
        whole = b" ".join([b"some words before", *words, b"and after"]).decode()
        covered = [x for k, *_, x in licenses.find(whole, a)[2] if k == which]
        want = brute_cover(K.alnum_words(whole), template)
        assert bool(covered) == (want >= licenses.COVERED)
        assert not covered or max(covered) == pytest.approx(want)
    half = b" ".join(template[: len(template) // 2]).decode()
    assert all(k != which for k, *_ in licenses.find(half, a)[2])


# --- line templates ----------------------------------------------------------------------------


def test_line_templates(spark):
    texts = [f"Order {i} shipped from warehouse north on day {i * 7}\nunique line number {'abcdefgh'[i]} of {words(i, 3)} kind" for i in range(5)]
    texts += [f"Contact the desk of {name} for more help about orders\n{' '.join(words(50 + k, 9, 10**6))}" for k, name in enumerate(["sales", "press", "legal", "travel"])]
    rows = [*enumerate(texts), (50, None), (51, ""), (52, "\n\n"), (53, "the end\nthe end\nthe end"), (0, texts[0])]
    df = table(spark, rows).withColumn("dropped_lines", F.lit("old"))
    got = {}
    for r in line_dedup.cleaned(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(r.dropped_lines == 1 and not r.text.startswith("Order") and r.text for i in range(5) for r in got[i])
    assert all(got[5 + k][0].dropped_lines == 1 and "Contact" not in got[5 + k][0].text for k in range(4))
    assert got[50][0].text is None and got[51][0].text == "" and got[52][0].text == "\n\n" and got[53][0].dropped_lines == 0
    assert line_dedup.cleaned(table(spark, [])).count() == 0


def test_variants_in_one_document_are_no_template(spark):
    form = lambda names: "\n".join(f"please write the name of {x} here" for x in names)
    alone = [(1, form(["alpha", "beta", "gamma", "delta"])), (2, "nothing of that kind in here"), (3, None)]
    assert {r.doc_id: (r.text, r.dropped_lines) for r in line_dedup.cleaned(table(spark, alone)).collect()} == {i: (t, 0) for i, t in alone}
    two = [*alone, (4, form(["alpha", "omega"])), (4, form(["alpha", "omega"]))]
    assert all(r.dropped_lines == 0 for r in line_dedup.cleaned(table(spark, two)).collect())
    three = [*two, (5, form(["sigma"]))]
    got = {r.doc_id: r.dropped_lines for r in line_dedup.cleaned(table(spark, three)).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 2, 5: 1}


# --- cover tree --------------------------------------------------------------------------------


def vectors(seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(25, 16))
    x = np.concatenate([c + g.normal(size=(20, 16)) * g.choice([0.05, 0.25, 0.35]) for c in centres])
    rows = [(i, x[i].tolist(), i % 3) for i in range(len(x))]
    rows += [(900 + i, rows[i % 7][1], 0) for i in range(30)] + [(950, (x[0] * 3).tolist(), 0)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [float("nan")] * 16, 1), (804, [1.0, None] * 8, 1), (805, rows[1][1], None), (806, [1.0, 2.0], 0), (807, [1.0, 2.0], 0), (1, rows[1][1], 1), (None, rows[2][1], 2), (808, [float("inf")] * 16, 0)]
    return rows


def brute_vectors(rows):
    fine = [e is not None and len(e) > 0 and lab is not None and all(v is not None and np.isfinite(v) for v in e) and any(e) for _, e, lab in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93 or rows[i][1] == rows[j][1]:
                links.append((i, j))
    root, n = unite(len(rows), links), [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = {}
    for (d, *_), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, k, least.get(r, d), d is not None and least.get(r, d) == d) for (d, *_), k, r in zip(rows, n, root)), key=str)


@pytest.mark.parametrize("block", [512, 16])
def test_cover_tree_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, cell int")
    got = sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str)
    assert got == brute_vectors(rows)


def test_pairs_of_blocks_do_not_move(spark, monkeypatch):
    """Blocks are read beside each other; vectors given as floats, and sums added up after every pair."""
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    monkeypatch.setattr(cover_tree, "SUMS", 1, raising=False)
    monkeypatch.setattr(cover_tree, "TREE_BYTES", 1, raising=False)
    plans, written = {}, cover_tree.scratch.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(cover_tree.scratch, "written", noted)
    rows = vectors(5)
    df = spark.createDataFrame([r[:3] for r in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str)
    as_float = lambda e: None if e is None else [None if v is None else float(np.float32(v)) for v in e]
    assert got == brute_vectors([(i, as_float(e), lab) for i, e, lab in rows])
    assert "Exchange hashpartitioning" not in plans["links"]


def test_labels_of_one_block_each(spark, monkeypatch):
    rows = [(i, [1.0, 0.1 * (i % 2), 0.0] if i % 3 else [0.0, 1.0, 0.0], i // 5) for i in range(200)] + [(500 + i, [1.0, 0.001 * i, 0.01 * (i % 9)], 99) for i in range(40)]
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str)
    assert got == brute_vectors(rows)


def test_no_vectors(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def test_mixture_reaches_its_targets(spark):
    stop = {"en": "the of and to is", "de": "der die und das ist"}
    rows, labels = [], []
    for i in range(300):
        lang = "de" if i % 3 == 0 else "en"
        junk = i % 5 == 0
        text = " ".join(f"{w}### $$$" for w in words(i, 20)) if junk else f"{stop[lang]} {' '.join(words(i, 15 + i % 30))}"
        rows.append((i, text, lang))
        if i % 2:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(900, None, None), (901, "", "en"), (None, "the of and", "en"), (7, rows[7][1], "en")]
    docs = spark.createDataFrame([(i, t, x, "s", 1, [1], 0.5, 2) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, bins array<int>, post double, _copies int")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    targets = {"en": 0.5, "de": 0.4, "junk": 0.1}
    out, m = mixing.mixture(docs, lab, targets)
    got = out.select("n_tokens", "post", "rate").collect()
    n, p, r = np.array([x.n_tokens for x in got], float), np.array([x.post for x in got]), np.array([x.rate for x in got])
    assert len(got) == len(rows) and (r >= 0).all() and np.abs(p.sum(axis=1) - 1).max() < 1e-3
    want = np.array([m.domains[k]["target"] for k in targets])
    assert np.allclose((n * r) @ p, want, rtol=1e-4) and np.allclose(want / want.sum(), list(targets.values()))
    # The same steps by hand.
    have = (n[:, None] * p).sum(axis=0)
    gram, x = (n[:, None] * p).T @ p, np.ones(len(n))
    assert np.allclose(want.sum(), 1.05 * max(have[i] / t for i, t in enumerate(list(targets.values())[:2])))
    for _ in m.history:
        x = np.maximum(0, x - p @ np.linalg.solve(gram, (n * x) @ p - want))
    assert np.allclose(x, r, atol=1e-6)
    drawn = mixing.mixed(docs, lab, targets)
    assert drawn.columns == docs.columns
    kept = {}
    for row in drawn.collect():
        kept[row.doc_id] = kept.get(row.doc_id, 0) + 1
    rate = {row.doc_id: row.rate for row in out.collect()}
    assert all(int(rate[i]) <= kept.get(i, 0) <= int(rate[i]) + 1 for i, *_ in rows if i not in (7, None))


def fitted(spark, monkeypatch, posts, targets):
    """A mixture of rows (n_tokens, post) as given, and its tokens by domain and rates."""
    monkeypatch.setattr(mixing, "learn", lambda *_: None)
    monkeypatch.setattr(mixing, "posterior", lambda rows, model: rows)
    df = spark.createDataFrame(posts, "n_tokens long, post array<double>")
    m = mixing.fit(df, df, targets)
    got = df.select("n_tokens", "post", m.rate().alias("r")).collect()
    n, p, r = np.array([x.n_tokens for x in got], float), np.array([x.post for x in got]), np.array([x.r for x in got])
    assert (r >= 0).all() and np.allclose((n * r) @ p, [m.domains[k]["reached"] for k in targets], rtol=1e-6, atol=1e-6 * n.sum())
    return m, n, p, r


@pytest.mark.parametrize("junk,share", [(0.9, 0.04), (0.2, 0.0)])
def test_mixture_where_rates_reach_zero(spark, monkeypatch, junk, share):
    rnd = np.random.default_rng(7)
    posts = []
    for _ in range(600):
        main = rnd.choice(3, p=[(1 - junk) * 0.7, (1 - junk) * 0.3, junk])
        q = rnd.dirichlet(np.where(np.arange(3) == main, 4.0, 0.6))
        # A third of the rows can't be junk, so that none of it can be reached.
        if rnd.random() < 1 / 3:
            q = np.array([q[0], 1 - q[0], 0.0])
        posts.append((int(rnd.integers(5, 500)), [round(float(x), 4) for x in q]))
    targets = {"en": 0.7 - share, "de": 0.3, "junk": share}
    m, n, p, r = fitted(spark, monkeypatch, posts, targets)
    want = np.array([m.domains[k]["target"] for k in targets])
    assert m.met and (r == 0).any() and np.abs((n * r) @ p - want).max() <= 2e-6 * want.sum()


def test_mixture_says_what_it_cannot_meet(spark, monkeypatch):
    posts = [(100, [0.7, 0.2, 0.1]), (50, [0.1, 0.8, 0.1]), (80, [0.2, 0.2, 0.6])]
    targets = {"en": 0.9, "de": 0.1, "junk": 0.0}
    m, n, p, r = fitted(spark, monkeypatch, posts, targets)
    assert not m.met and m.domains["junk"]["reached"] > 0
    # No rate can change to bring the whitened misses down.
    slope = p @ np.linalg.solve((n[:, None] * p).T @ p, (n * r) @ p - np.array([m.domains[k]["target"] for k in targets]))
    assert (np.abs(slope[r > 0]) < 1e-5).all() and (slope[r == 0] > -1e-5).all()


def test_mixture_of_nothing(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixture(table(spark, []), lab)[0].count() == 0
    out = mixing.mixed(table(spark, [(1, None), (2, "")]), lab)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]
