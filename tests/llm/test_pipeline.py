"""The stages in turn, each against a plain version of its decision."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from factline.llm import common as K
from factline.llm import mixing, tokens, toxicity
from factline.llm.common import table
from tests.conftest import DATA
from tests.llm.test_operators import assert_one_each


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_ids"]


def contaminated(text, items):
    """Whether 13 words in a row, at most 2 of them different, stand in both; shorter items whole."""
    w = np.array([zlib.crc32(x) for x in K.alnum_words(text)], np.int64)
    for v in items:
        size, miss = (13, 2) if len(v) >= 13 else (len(v), 0)
        n, m = len(w) - size + 1, len(v) - size + 1
        if size and n > 0 and m > 0:
            same = w[:, None] == v[None, :]
            if (sum(same[k : k + n, k : k + m].astype(np.int8) for k in range(size)) >= size - miss).any():
                return True
    return False


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from factline.sources import scratch

    docs = table(spark, DATA, "documents")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(scratch.written(stage(spark, results[-1], DATA), name))
    assert all(r.columns == docs.columns for r in results[:-1])
    before, clean, single, decontaminated, mixed = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in results[:-1]]

    grammar = toxicity.fit(docs, table(spark, DATA, "labels"))
    lexer, weights = toxicity.Lexer(grammar), np.array(grammar.weights)
    z = np.log1p(np.array([toxicity.events(t, lexer)[0] for _, t in before])) @ weights[:-1] + weights[-1]
    assert Counter(clean) == Counter(x for x, v in zip(before, z) if v < 0) and len(clean) < len(before)

    assert_one_each(single, clean)
    assert len(single) < len(clean)

    items = [np.array([zlib.crc32(x) for x in K.alnum_words(r.text)], np.int64) for r in table(spark, DATA, "benchmark").collect()]
    assert Counter(decontaminated) == Counter(x for x in single if not contaminated(x[1], items))
    assert len(decontaminated) < len(single)

    rates, _ = mixing.mixture(results[3], table(spark, DATA, "labels"))
    rate = {r.doc_id: r.rate for r in rates.collect()}
    hashes = results[3].select("doc_id", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 30)).alias("h")).collect()
    copies = {r.doc_id: int(np.floor(rate[r.doc_id] + r.h / (1 << 30))) for r in hashes}
    assert len(copies) == len(decontaminated)
    assert Counter(d for d, _ in mixed) == Counter({d: n for d, n in copies.items() if n})
    assert set(mixed) <= set(decontaminated)

    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END_ID] for d, t in mixed}
    at = 0
    for r in sorted(results[-1].collect(), key=lambda r: r.start):
        own = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += r.n_tokens
    assert at == sum(len(ids[d]) for d, _ in mixed)
