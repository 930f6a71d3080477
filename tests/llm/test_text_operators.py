"""The text operators against brute force, round trips and held-out accuracy, and over odd inputs."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weirlight.llm import chat_format, components, decontaminate, fingerprints, jaccard_join, language_id, mixing, quality, queries, token_store, toxicity, url_filters
from weirlight.llm._shared import materialise, with_next
from weirlight.llm._words import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one", "en", None, 3), (5, "a b c d e f g h", "en", "b", 15), (6, "a b c d e f g h", "en", "b", 15), (None, "a b c d e f g i", None, "b", 15), (7, "ünïcode \U0001f600 " * 3000, "de", "c", 33000), (7, "a b c d e f g h", "en", "b", 15)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def larger_dir():
    return "/root/testdata/sf0.01"


def held(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    cell = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    normal = lambda df: sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert normal(queries.queries()[name](spark, sf_dir).toPandas()) == normal(duck.execute(queries.oracle_sql()[name]).df())


# Words


def test_words_and_shingles():
    same = word_hashes("a  bc\td\x0be")
    assert len(same) == 4 and (same == word_hashes("a bc d e")).all() and len(word_hashes(None)) == len(word_hashes(" \n")) == 0
    assert len(set(word_hashes("x y z").tolist())) == 3 and word_hashes("ab c")[0] != word_hashes("a bc")[0]
    long = "word " * 700_000
    assert len(word_hashes(long)) == 700_000 and len(np.unique(word_hashes(long))) == 1
    assert len(shingle_hashes(word_hashes("a b"))) == 1 and len(shingle_hashes(word_hashes("a b c d e f"))) == 2


# 1 Language


def test_language_codewords_differ():
    for n in (2, 4, 9):
        m = language_id.codewords(n)
        assert min((m[i] != m[j]).sum() for i in range(n) for j in range(i)) >= 1
    assert (language_id.codewords(4).shape) == (4, 7)


def model_with(margins, n=4):
    """A model that gives these margins for whatever text."""
    codes = language_id.codewords(n)
    return language_id.Model([f"l{i}" for i in range(n)], codes, np.zeros((language_id.DIM, codes.shape[1])), np.array(margins, float), np.full(codes.shape, 1 / codes.shape[1]))


def test_a_wrong_bit_is_corrected_and_ties_are_ambiguous():
    codes = language_id.codewords(4)
    for i, code in enumerate(codes):
        for bit in range(len(code)):
            wrong = code.copy()
            wrong[bit] *= -1
            model = model_with(wrong)
            found = model.predict(["any text"]).iloc[0]
            assert found["lang_pred"] == f"l{i}" and not found["ambiguous"] and 0 < found["score"] < 1
            plain = [sum(max(0, 1 - m * c) ** 2 for m, c in zip(wrong, row, strict=True)) / len(code) for row in codes]
            assert np.allclose(model.losses(np.zeros((1, language_id.DIM)))[0], plain)
    tie = model_with((codes[0] + codes[2]) / 2).predict(["any text"]).iloc[0]
    assert {tie["lang_pred"], tie["runner_up"]} == {"l0", "l2"} and tie["ambiguous"]


def test_letters_by_category():
    for text in ("\u00bd \u00b2", "\u2167", "\u2460\u2461", "12 _ ...", "\u0301", "", None):
        assert language_id.letter_runs(text) is None
    word = "\u0939\u093f\u0928\u094d\u0926\u0940"
    assert language_id.letter_runs(f"1{word}--A\u0301b!").tolist() == [32, *map(ord, word), 32, ord("a"), 0x301, ord("b"), 32]
    counts = language_id.ngram_rates("ab " * 700_000)
    assert np.allclose(counts, language_id.ngram_rates("ab " * 7), atol=0.1) and np.isclose((counts**2).sum(), 1, atol=1e-3)


def test_columns_of_the_same_name(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("language", F.lit("own")).withColumn("quality", F.lit("own")).withColumn("toxicity", F.lit("own")).withColumn("score", F.lit("own")).withColumn("label", F.lit("own"))
    for found, out in (
        (language_id.identify(docs, language_id.fit(docs)), "language"),
        (quality.score_documents(docs, quality.fit(docs, labels, 3, 9)), "quality"),
        (toxicity.score_documents(docs, toxicity.fit(docs, labels)), "toxicity"),
    ):
        assert found.columns == docs.columns and found.where(f"{out}.score is not null").count() == len(ODD)
        assert found.where("score = 'own' and label = 'own'").count() == len(ODD)


def test_language_held_out(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).select("doc_id", "lang")
    found = queries.op1_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.9 and found["score"].between(0, 1).all()


def test_language_odd(odd, none):
    found = language_id.identify(odd, language_id.fit(odd)).select("doc_id", "text", "language.*").collect()
    assert len(found) == len(ODD) and all(r["lang_pred"] == "und" for r in found if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(none)).select("language.lang_pred").collect()} == {"und"}


# 2 Chat


def test_preferences(spark):
    t = [("p", c, k, r, x) for c, end in ((True, "yes"), (False, "no")) for k, r, x in ((0, "system", "s"), (1, "user", None), (2, "assistant", end))]
    t += [("q", c, k, "user", "same") for c in (True, False) for k in (0, 0, 1)] + [("r", True, 5, None, "only")]
    for block in (1, 64):
        found = {r["pair_id"]: r for r in chat_format.format_preferences(spark.createDataFrame(t, "pair_id string, chosen boolean, turn long, role string, text string"), turns_per_block=block).collect()}
        p = found["p"]
        assert p["prompt"] == "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n" and p["n_prompt_turns"] == 2
        assert (p["chosen"], p["rejected"]) == ("<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
        assert p["chosen_mask"] == f"{len('<|assistant|>') + 1}:0,{len('yes<|end|>') + 1}:1"
        assert found["q"]["chosen"] == found["q"]["rejected"] == "" and found["q"]["n_prompt_turns"] == 2
        assert found["r"]["prompt"] == "" and found["r"]["rejected"] == "" and found["r"]["chosen"].startswith("<|unknown|>")


def test_preferences_of_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_preferences(chat_format.swapped_answers(none)).count() == 0


# 3 Quality


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    total, bad = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> k) & 1 for k in range(6)]
        w = np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, bad = total + w, bad + w * np.array(y)
    assert np.allclose(quality.marginals(unary, pair), bad / total)
    assert np.allclose(quality.forward_backward(unary[None], pair, np.array([6]))[0][0], bad / total)


def test_quality_held_out(spark, larger_dir):
    found = queries.op3_quality_classifier(spark, larger_dir).join(queries.labels(spark, larger_dir).withColumnRenamed("quality", "truth"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found["predicted"] == found["truth"]).mean() > 0.9 and found["score"].between(0, 1).all()


def test_very_long_lines_keep_scores_in_bounds(spark):
    rows = [(i, " ".join(["good words here."] * (3 + i)), 1) for i in range(20)] + [(100 + i, "$$$ ### " * (3 + i), 0) for i in range(20)] + [(200, "x" * 800_000, 1), (201, "y z\n" * 100_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, 3, 9)
    assert np.isfinite(model.weights).all() and np.isfinite(model.pair).all()
    found = quality.score_documents(docs, model).select("doc_id", "quality.score").toPandas().set_index("doc_id")["score"]
    assert found.between(0, 1).all() and found[5] > 0.5 > found[105]


def test_quality_weighs_lines_by_length():
    model = quality.Model(np.zeros(quality.N_FEATURES), np.zeros((2, 2)), np.ones(quality.N_FEATURES), (1.0, 0.0))
    model.weights[14] = 50.0  # a line without words is surely bad
    x, size = quality.line_features("aa bb\n\ncccc")
    bad = quality.marginals(x @ model.weights, model.pair)
    q, lines, bad_lines = model.quality("aa bb\n\ncccc")
    assert size.tolist() == [4, 0, 4] and (lines, bad_lines) == (3, int((bad >= 0.5).sum())) and np.isclose(q, 1 - (bad * size).sum() / size.sum())


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(odd, labels, 3, 9), None):
        found = quality.score_documents(odd, model).select("text", "quality.score").collect()
        assert len(found) == len(ODD) and all(r["score"] == 0 for r in found if not (r["text"] or "").strip())
    assert quality.score_documents(none, None).count() == 0


# 4 Toxicity


def test_folding():
    assert toxicity.fold("You 1d10t!! M0r0n, $cum, id!ot; s-t-u-p-i-d Соol ídiot x\u200bdumb").split() == "you idiot moron scum idiot stupid cool idiot xdumb".split()
    assert toxicity.fold(None).strip() == toxicity.fold(" \n ").strip() == ""
    assert "idiot" in toxicity.fold("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d")


def test_exceptions_excuse_hits():
    lexicon = toxicity.Lexicon({"scum": 3.0}, ["scumble paint"])
    a = lexicon.matcher()
    assert toxicity.raw_sums("the scumble paint dries", a)[1] == 0 and toxicity.raw_sums("the scumble dries", a)[1] == 1
    many = "scumble paint " * 100 + "scum"
    assert toxicity.raw_sums(many, a)[1] == 1


def test_matches_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(300):
        word = lambda most: "".join(rng.choice(list("abc"), int(rng.integers(1, most))))
        weights = {word(4) + (" " if rng.random() < 0.4 else ""): float(rng.integers(1, 9)) for _ in range(int(rng.integers(1, 8)))}
        exceptions = sorted({" ".join(word(5) for _ in range(int(rng.integers(1, 3)))) for _ in range(int(rng.integers(0, 4)))})
        words = [word(6) for _ in range(int(rng.integers(1, 150)))]
        text = toxicity.fold(" ".join(words))
        hits, forms = 0, {}
        excused = [(i, i + len(e) + 1) for e in exceptions for i in range(len(text)) if text.startswith(f" {e} ", i)]
        for i in range(len(text)):
            own = [e for e in weights if text.startswith(f" {e}", i)]
            if own:
                best = max(own, key=len)
                if not any(a <= i and i + len(best) <= b for a, b in excused):
                    hits += 1
                    key = (text[i : text.index(" ", i + 1)], weights[best])
                    forms[key] = forms.get(key, 0) + 1
        total, found, n = toxicity.raw_sums(" ".join(words), toxicity.Lexicon(weights, exceptions).matcher())
        assert (found, n) == (hits, len(words)) and np.isclose(total, sum(w * (1 + np.log(k)) for (_, w), k in forms.items()))


def test_very_long_texts_are_matched_whole():
    a = toxicity.Lexicon({"scum": 3.0}).matcher()
    assert toxicity.raw_sums("clean words " * 300_000 + "Scum", a)[1:] == (1, 600_001)


def test_toxicity_held_out(spark, larger_dir):
    found = queries.op4_toxicity(spark, larger_dir).join(queries.labels(spark, larger_dir), "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found["predicted"] == found["toxic"]).mean() > 0.9 and found["score"].between(0, 1).all()


def test_toxicity_odd(spark, odd, none):
    found = toxicity.score_documents(odd, toxicity.Lexicon({"bcd": 1.0}, [], (1.0, 1.0, 0.0))).select("toxicity.score").collect()
    assert len(found) == len(ODD) and all(r["score"] < 0.5 for r in found)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0


# 5 Urls


def test_rules_by_brute_force(spark):
    rng = np.random.default_rng(1)
    hosts = [".".join(rng.choice(["a", "b", "ab"], rng.integers(1, 4))) for _ in range(40)]
    paths = ["/" + "".join(rng.choice(list("xy/"), rng.integers(0, 5))) for _ in range(40)]
    rules = sorted({(str(h), str(p)): str(v) for h, p, v in zip(rng.choice(hosts, 60), rng.choice(paths, 60), rng.choice(["allow", "block"], 60), strict=True)}.items())
    urls = [f"http://{h}{p}" for h, p in zip(rng.choice(hosts, 300), rng.choice(paths, 300), strict=True)] + [None, "none", "x://", "x://A.B?q#/", "x://a.b#/x"] + ["http://a.b/x"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    truth = sorted(((i, *judged(u)) for i, u in enumerate(urls)), key=repr)
    for block in (50_000, 7):
        assert held(url_filters.judge_urls(pages, table, rules_per_block=block, rows_per_copy=100), "page_id", "host", "path", "rule", "verdict") == truth
    assert url_filters.judge_urls(pages, table.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filters.judge_urls(pages.limit(0), table).count() == 0


# 6 Tokens


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 50, 3000).astype(np.uint16)
    for block in (64, 1 << 16):
        w = token_store.unpack(token_store.pack(ids, 6, block))
        assert (w.decode() == ids).all() and all(w.access(i) == ids[i] for i in (0, 17, 2047, 2999))
        for value in (0, 7, 49):
            at = np.flatnonzero(ids == value)
            assert (w.occurrences(value) == at).all() and [w.select(value, k) for k in (0, 5, len(at) - 1)] == [at[0], at[5], at[-1]]
            assert [w.rank(value, end) for end in (0, 1, 63, 64, 1000, 3000)] == [(ids[:end] == value).sum() for end in (0, 1, 63, 64, 1000, 3000)]
            assert w.select(value, len(at)) == w.select(value, -1) == -1
        assert w.rank(63, 3000) == w.rank(64, 10) == 0 and w.select(64, 0) == -1 and not len(w.occurrences(63))
    wide = np.random.default_rng(3).integers(0, 1 << 20, 500).astype(np.uint32)
    assert (token_store.unpack(token_store.pack(wide, 20, 128)).decode() == wide).all()
    empty = token_store.unpack(token_store.pack(ids[:0], 6))
    assert len(empty.decode()) == empty.rank(3, 5) == 0 and empty.select(3, 0) == -1
    with pytest.raises(ValueError):
        token_store.unpack(b"none")


def test_rank_and_select_inflate_few_blocks():
    ids = np.random.default_rng(5).integers(0, 1 << 16, 200_000).astype(np.uint16)
    record = token_store.pack(ids, 16, 1 << 12)
    for ask, most in ((lambda w: w.access(123_456), 16), (lambda w: w.rank(int(ids[9]), 150_000), 32), (lambda w: w.select(int(ids[9]), 0), 48)):
        w = token_store.unpack(record)
        ask(w)
        assert 0 < w.inflated <= most < w.blocks * w.bits


def encoded(enc, texts):
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return Tokenizer.from_file(path), token_store.Encoder(path)


def test_pieces_are_encoded_as_wholes(bpe):
    whole, enc = bpe
    assert enc.cuts
    texts = ["", "  a  b", " x", "a\n \nb  ", "it's 's  'll\t\tfoo \n bar.. baz,,,", "a <|endoftext|> b", "x. \n\n y", "don't. we've!! \n", "1,000.50 3rd _a_", "a,b.c\nd,\ne. f", ",a .b", "x\x01y z", "a\u00a0b c", "\u0120x y", "a\u0301b \u0301c", "\U0001f44d x", "One two, three. Four\nFive six."] * 2
    assert encoded(enc, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(enc, [None, "", "a"])[:2] == [[], []]


BITS = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "a", "B", "the", "\u00e9", "\u00d7", "\u00b2", "0", "12", ",", "...", "\u2009", "\u00a0", "\u3000", "\u201c", "\u0441\u043b", "\u6f22", "\U0001f642", "\x1c", "\x85", "<|endoftext|>", "\u200b", "\u180e", "_"]


@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join) | st.text(max_size=8), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_agrees_with_the_library(bpe, texts):
    whole, enc = bpe
    assert encoded(enc, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_late_pieces(bpe, monkeypatch):
    monkeypatch.setattr(token_store.Encoder, "MOST", 6)
    enc = token_store.Encoder(queries.tokenizer_path())
    for texts in (["a b c", "d e"], ["f g h i j k l m n"], ["a b c d e f", "n m l"], ["x" * 70 + " a", ""]):
        assert encoded(enc, texts) == [bpe[0].encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc._known) <= 6


def test_other_tokenizers_encode_wholes():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    whole, enc = Tokenizer.from_file(path), token_store.Encoder(path)
    texts = ["Some words,  and \n more.", "", "it's 3rd"]
    assert not enc.cuts and encoded(enc, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_under_a_path(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 7)) for i in range(500)], "doc_id long, text string").repartition(7)
    path = f"{tmp_path}/store"
    kept = token_store.write_store(docs, queries.tokenizer_path(), path, tokens_per_shard=100, rows_per_part=40)
    again = token_store.open_store(spark, path)
    assert kept.count() == again.count() > 50
    rows = token_store.read_store(again).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(500))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))


def test_store_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    found = token_store.read_store(token_store.write_store(odd, queries.tokenizer_path(), tokens_per_shard=50, rows_per_part=3)).orderBy("start").collect()
    assert len(found) == len(ODD)
    left, at = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        fits = [t for t in left if t[0] == r["doc_id"] and zlib.crc32(np.array([*whole.encode(t[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) == r["ids_crc32"]]
        assert fits
        left.remove(fits[0])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i or 0))
    assert token_store.read_store(token_store.write_store(none, queries.tokenizer_path())).count() == 0


# 7 Near copies


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        w = [x for x in w if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    linked = {s: [o for o in distinct if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in distinct}
    group, number = {}, 0
    for s in distinct:
        if s not in group:
            number += 1
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = number
                    todo += linked[x]
    return [(None, 0) if s is None else (group[s], len(linked[s])) for s in sets]


@pytest.mark.parametrize("small", [200, 4, 3])
def test_near_copies_by_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    texts = [None, "", "one two", "one two"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for k in rng.choice(60, rng.integers(0, 3), replace=False):
                w[k] = str(rng.choice(words))
            texts.append(" ".join(w))
    texts += [base[0] + " " + " ".join(rng.choice(words, 60)) for _ in range(5)] + base[:2] * 4
    monkeypatch.setattr(jaccard_join, "SMALL", min(small, 200))
    monkeypatch.setattr(jaccard_join, "TASK", 50_000 if small > 3 else 40)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1_000_000 if small > 3 else 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for clash in ("class_id", "uid", "n_links", "first_of_class", "id", "kept", "sig"):
        docs = docs.withColumn(clash, F.lit("clash"))
    found = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(docs, keep=tuple(docs.columns)).collect()}
    assert all(r["kept"].asDict() == {c: {"doc_id": i, "text": texts[i]}.get(c, "clash") for c in docs.columns} for i, r in found.items())
    truth = brute_classes(texts)
    assert [found[i]["n_links"] for i in range(len(texts))] == [n for _, n in truth]
    for i, (g, _) in enumerate(truth):
        same = [j for j, (h, _) in enumerate(truth) if h == g] if g is not None else [i]
        assert found[i]["class_id"] == min(same) and found[i]["first_of_class"] == (i == min(same))


def similar_signatures(rng, pairs, similarity):
    """Rows 2i and 2i + 1 agree at a slot with the similarity as probability; other rows don't."""
    sig = rng.integers(0, 2**32, (2 * pairs, jaccard_join.SLOTS), dtype=np.uint32)
    sig[1::2] = np.where(rng.random(sig[1::2].shape) < similarity, sig[::2], sig[1::2])
    return sig


def test_paths_keep_pairs_as_often_as_stated():
    rng = np.random.default_rng(8)
    pairs, together = 4000, 0
    sig = similar_signatures(rng, pairs, 0.8)
    paths = [[np.uint64(x)] for x in rng.integers(0, 2**63, pairs)]
    for _ in range(12):
        for i, own in enumerate(paths):
            if own:
                row, path = jaccard_join.longer(np.array(own * 2, np.uint64), np.repeat(sig[2 * i : 2 * i + 2], len(own), 0), 0.8)
                paths[i] = list(set(path[row < len(own)].tolist()) & set(path[row >= len(own)].tolist()))[:20]
    together = np.mean([bool(p) for p in paths])
    assert abs(together - (1 - jaccard_join.lost_in_a_run(0.8))) < 0.05
    for target in (0.5, 0.9, 0.99999):
        runs, lost = jaccard_join.runs_for(target, 0.8), jaccard_join.lost_in_a_run(0.8)
        assert lost**runs <= 1 - target + 1e-9 and (runs == 1 or lost ** (runs - 1) > 1 - target)
    with pytest.raises(ValueError):
        jaccard_join.runs_for(1.0, 0.8)


@pytest.mark.parametrize("target", [0.8, 0.99])
def test_measured_recall_reaches_its_target(spark, monkeypatch, target):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "TASK", 60)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 0 if target == 0.8 else 4)
    rng = np.random.default_rng(4)
    pairs = 600
    sig = similar_signatures(rng, pairs, 0.8)
    # A token that all share at a few slots makes large buckets, which have to be split.
    sig[:, ::9] = 7
    near = (sig[::2] == sig[1::2]).mean(1) >= jaccard_join.NEAR
    starts, slots = jaccard_join._roots(0.8, jaccard_join.runs_for(target, 0.8))
    rows = [(i, s.tobytes(), jaccard_join._step(starts, s[slots], slots).view(np.int64).tolist()) for i, s in enumerate(sig)]
    nodes = spark.createDataFrame(rows, "uid long, sig binary, paths array<long>")
    if target == 0.8:
        monkeypatch.setattr(jaccard_join, "TASK", 10**6)
    links = {tuple(sorted(r)) for table in jaccard_join.candidate_links(nodes, 0.8) for r in table.collect()}
    found = np.mean([(2 * i, 2 * i + 1) in links for i in np.flatnonzero(near)])
    assert found >= target


def test_split_finds_components():
    rng = np.random.default_rng(9)
    sig = np.repeat(rng.integers(0, 2**32, (30, jaccard_join.SLOTS), dtype=np.uint32), 40, 0)
    change = rng.random(sig.shape) < 0.1
    sig[change] = rng.integers(0, 2**32, change.sum(), dtype=np.uint32)
    uids = rng.permutation(10**6)[: len(sig)].astype(np.int64)
    root = jaccard_join.split_to_the_end(uids, sig, np.uint64(5), 0.8)
    # Some groups may stay apart in one run, none may be mixed.
    assert all((root[k * 40 : k * 40 + 40] // 40 == k).all() for k in range(30))
    equal = np.repeat(sig[:1], 500, 0)
    assert (jaccard_join.split_to_the_end(np.arange(500), equal, np.uint64(5), 0.8) == 0).all()


def test_near_copies_odd(odd, none):
    found = jaccard_join.jaccard_classes(odd, keep=tuple(odd.columns))
    assert found.count() == len(ODD) and found.where("first_of_class").count() == 7
    assert jaccard_join.jaccard_classes(none).count() == jaccard_join.jaccard_classes(none, keep=("lang",)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (7, 7), (100, 90), (None, 3), (200, None)] + [(300, 300 + i) for i in range(1, 200)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(31)} == {0} and found[100] == found[95] == 90 and {found[300 + i] for i in range(200)} == {300} and 200 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 Mixing


def test_mix_meets_targets(spark, odd, none):
    found = mixing.mix_documents(odd, rows_per_bucket=2).toPandas()
    assert len(found) == len(ODD) and (found["taken"] <= 2 * found["size"]).all()
    sums = found.fillna({"source": "?"}).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (sums["size"] == sums["source_size"]).all() and (abs(sums["taken"] - sums["target"]) < 1).all() and (sums["target"] <= 2 * sums["source_size"]).all()
    assert abs(sums["target"].sum() - 1.5 * sums["size"].sum()) < 1e-6
    again = mixing.mix_documents(odd.repartition(3), rows_per_bucket=2)
    assert held(again, "doc_id", "size", "taken") == held(mixing.mix_documents(odd, rows_per_bucket=2), "doc_id", "size", "taken")
    assert mixing.mix_documents(none).count() == 0


def test_targets_by_resharing(spark):
    rng = np.random.default_rng(6)
    for count in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 2000, count) ** rng.choice([1, 1, 2], count)] + [0]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        target, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
        while left > 1e-6 and open_:
            share = left / sum(weights[i] for i in open_)
            left = 0.0
            for i in sorted(open_):
                target[i] += share * weights[i]
                if target[i] >= 2 * sizes[i]:
                    left += target[i] - 2 * sizes[i]
                    target[i] = 2.0 * sizes[i]
                    open_.discard(i)
        df = spark.createDataFrame([(False, f"s{i:03d}", n) for i, n in enumerate(sizes)], "no_source boolean, src string, size long")
        found = [r["target"] for r in mixing.source_targets(df).orderBy("src").collect()]
        assert np.allclose(found, target, rtol=1e-9, atol=1e-4)


# 9 Benchmark


def test_planted_passages(spark):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(400)]
    item = [str(w) for w in rng.choice(words, 30)]
    host = lambda: [str(w) for w in rng.choice(words, 80)]
    cases = {"exact": item, "changed": [w if k % 7 else "zz" for k, w in enumerate(item)], "half": item[:15], "lost": item[:14] + item[16:], "few": item[:6], "spread": [x for w in item for x in (w, "q")]}
    texts = {k: " ".join(host()[:40] + v + host()[:40]).upper() for k, v in cases.items()} | {"clean": " ".join(host()), "none": None, "empty": "", "short": "only these four words", "shorter": "only these four"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, "zz yy"), (4, "Only, these four words!")], "item_id long, text string")
    docs = docs.withColumn("kept", F.lit(1)).withColumn("item", F.lit(2)).withColumn("hits", F.lit("replaced"))
    both = []
    for most in (4_000_000, 0):
        rows = decontaminate.contamination(docs, bench, most_spans=most)
        found = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in rows.collect()}
        assert {k for k, v in found.items() if v} == {"exact", "changed", "half", "lost", "short"} and found["short"] == {4} and len(found) == len(texts)
        assert set(rows.columns) == set(docs.columns)
        both.append(held(rows, *docs.columns))
        assert decontaminate.contamination(docs, bench.limit(0), most_spans=most - 1).where("size(hits) > 0").count() == 0
        assert decontaminate.contamination(docs.limit(0), bench, most_spans=most).count() == 0
    assert both[0] == both[1]


def test_long_repeated_and_odd_texts_are_searched(spark, odd):
    item = [f"t{i}" for i in range(30)]
    long = " ".join(["x y z"] * 60_000 + item + ["x y z"] * 60_000)
    docs = spark.createDataFrame([(1, long), (1, long), (2, " ".join(item * 40))], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item))], "item_id long, text string")
    for most in (4_000_000, 0):
        found = decontaminate.contamination(docs, bench, most_spans=most).where("size(hits) > 0").collect()
        assert sorted((r["doc_id"], [tuple(h) for h in r["hits"]]) for r in found) == [(1, [(5, 30, 30, 180_000)] * 2)] * 2 + [(2, [(5, 30, 30, 0)] * 2)]


def plain_hits(words, item, masks):
    """Diagonals at which all places that some mask looks at are equal, by trying every pair of places."""
    return sorted({a - b for m in masks for a in range(len(words) - len(m) + 1) for b in range(len(item) - len(m) + 1) if all(words[a + k] == item[b + k] for k, use in enumerate(m) if use == "1")})


def plain_run(same):
    """Bounds of the maximal scoring segments of a row of equal (1) and other words (-1.5), each the best of what is left."""
    found, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        sums = np.r_[0, np.cumsum(np.where(same[a:b], 1.0, -1.5))]
        best, lo, hi = max(((sums[j] - sums[i], i, j) for i in range(len(sums)) for j in range(i + 1, len(sums))), key=lambda x: (x[0], x[2] - x[1]), default=(0, 0, 0))
        if best > 0:
            found.append((a + lo, a + hi))
            todo += [(a, a + lo), (a + hi, b)]
    return found


def test_search_by_brute_force():
    rng = np.random.default_rng(12)
    hits = 0
    for turn in range(60):
        item = [f"w{i}" for i in rng.integers(0, 500, int(rng.integers(9, 40)))]
        copy = [w if rng.random() > (0.0, 0.15, 0.3, 0.45)[turn % 4] else "zz" for w in item]
        text = [f"w{i}" for i in rng.integers(0, 500, 20)] + copy[int(rng.integers(0, 8)) :] + [f"w{i}" for i in rng.integers(0, 500, 15)]
        diagonals = plain_hits(text, item, decontaminate.MASKS)
        runs = []
        for d in diagonals:
            low, high = max(0, -d), min(len(item), len(text) - d)
            same = np.array([item[i] == text[i + d] for i in range(low, high)])
            for a, b in plain_run(same):
                places = low + np.flatnonzero(same[a:b]) + a
                if len(places) >= 4:
                    runs.append((d, places))
        near = [[r for r in runs if abs(r[0] - d) <= 8] for d, _ in runs]
        most = max((len({int(p) for _, own in w for p in own}) for w in near), default=0)
        need = min(13, int(np.ceil(0.6 * len(item))))
        found = decontaminate.Index([(turn, " ".join(item))]).search([" ".join(text)])[0]
        assert [(h[0], h[1]) for h in found] == ([(turn, most)] if most >= need else [])
        hits += len(found)
    assert 20 < hits < 60


def test_both_sides_of_a_replaced_stretch_count():
    item = [f"t{i}" for i in range(32)]
    for k, many in ((8, 24), (9, 23), (16, 16)):
        at = (32 - k) // 2
        text = " ".join(["before"] * 40 + item[:at] + ["other"] * k + item[at + k :] + ["after"] * 40)
        assert decontaminate.Index([(1, " ".join(item))]).search([text]) == [[(1, many, 32, 40)]]


def test_all_runs_of_four_words_along_a_diagonal():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(40) < rng.choice([0.4, 0.6, 0.9])
        item = np.arange(40, dtype=np.uint64)
        runs = decontaminate.runs_along(np.r_[np.zeros(5, np.uint64) + 99, np.where(same, item, 99)].astype(np.uint64), item, 5)
        places = [int(p) for _, own, _ in runs for p in own]
        long = {i + m.start() for m in re.finditer("1{4,}", "".join("01"[int(x)] for x in same)) for i in range(len(m[0]))}
        assert long <= set(places) and len(places) == len(set(places)) and same[places].all() and all(first == own[0] + 5 for _, own, first in runs)


def test_a_copy_among_many_repeats_of_a_phrase():
    item = [f"t{i}" for i in range(32)]
    copy = [x for at in range(0, 32, 8) for x in (*item[at : at + 8], "added")]
    repeats = [x for k in range(100) for x in (*item[10:19], *[f"line{k}"] * 30)]
    text = " ".join(repeats + ["between"] * 40 + copy)
    # The last 8 words hold no whole span of 9, so that run has no seed.
    assert decontaminate.Index([(1, " ".join(item))]).search([text]) == [[(1, 24, 32, len(repeats) + 40)]]


def test_runs_together_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        runs = []
        for _ in range(int(rng.integers(1, 150))):
            diagonal = int(rng.integers(-20, 400))
            places = np.unique(rng.integers(0, 40, 9))
            runs.append((diagonal, places, int(places[0]) + diagonal))
        windows = [[r for r in runs if abs(r[0] - at) <= 8] for at, *_ in runs]
        most, first = max((len({int(p) for r in w for p in r[1]}), -min(r[2] for r in w)) for w in windows)
        assert decontaminate.together(runs) == (most, -first)
    assert decontaminate.together([]) == (0, 0)


# 10 Fingerprints


def test_fingerprints_by_brute_force(spark, odd, none):
    found = fingerprints.fingerprint_documents(odd).collect()
    rows = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] not in (7,)}
    ring = [r for r in rows]
    for r, nxt in zip(ring, [*ring[1:], ring[0]], strict=True):
        if r[0] == 7 or nxt[0] == 7:
            continue
        a, b = r[1] or "", nxt[1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert by_id[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by_id[r[0]]["n_chars"] == len(a)
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] and len(by_id[5]["fingerprint"]) == fingerprints.BINS
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == fingerprints.NO_WORDS
    assert fingerprints.fingerprint_documents(none).count() == 0


def spark_hash(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text):
    """One-permutation MinHash word by word: least hashes of bins, empty bins filled by draws, low bits as digits."""
    words = [spark_hash(w) for w in re.split(r"[\x20\t-\r]+", text or "") if w]
    if not words:
        return fingerprints.NO_WORDS
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    filled = {}
    for run in runs:
        h = spark_hash(*run)
        b = (h >> 56) + 128
        filled[b] = min(h, filled.get(b, h))
    digits = []
    for b in range(256):
        place = b.to_bytes(4, "little")
        tries = [spark_hash(place, t.to_bytes(4, "little")) % 256 for t in range(fingerprints.PROBES)]
        own = next((filled[c] for c in [b, *tries] if c in filled), None)
        h = own if own is not None else min((spark_hash(place, c), h) for c, h in filled.items())[1]
        digits.append("0123456789abcdef"[h & 15])
    return "".join(digits)


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(13)
    texts = [None, "", " \t", "one", "one two three four", "a b c d e", "x " * 50, "\u00fc\u4e16 \U0001f600 z y x w"] + [" ".join(f"w{k}" for k in rng.integers(0, 10**6, n)) for n in (6, 12, 40, 300, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = dict(tuple(r) for r in df.select("i", fingerprints.fingerprint(F.col("text"))).collect())
    assert [found[i] for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]


def test_likeness_is_near_jaccard(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    pairs = []
    for k in range(40):
        a = rng.choice(words, 400)
        b = a.copy()
        b[: k * 10] = rng.choice(words, k * 10)
        s, t = ({tuple(x[i : i + 5]) for i in range(396)} for x in (a, b))
        pairs.append((" ".join(a), " ".join(b), len(s & t) / len(s | t)))
    df = spark.createDataFrame(pairs, "a string, b string, j double")
    found = df.select("j", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("l")).toPandas()
    assert abs(found["l"] - found["j"]).max() < 0.15 and abs((found["l"] - found["j"]).mean()) < 0.02


def test_next_rows_over_buckets(spark):
    ids = [5, 5, 5, 9, 2, 7, 7, 1, None, 3] * 3
    df = spark.createDataFrame([(i, k % 5 - 2) for k, i in enumerate(ids)], "id long, tie long").distinct()
    order = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    found = with_next(df.withColumn("v", F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("-")), "tie")), "id", "tie", ["v"], rows_per_bucket=2).collect()
    name = lambda r: f"{'-' if r[0] is None else r[0]}/{r[1]}"
    assert {r["v"]: r["next_v"] for r in found} == {name(a): name(b) for a, b in zip(order, [*order[1:], order[0]], strict=True)}


# The pipeline


def test_stages_take_effect(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    columns, before = docs.columns, docs.count()
    stages = dict(corpus_pipeline.STAGES)
    stages = {name: lambda *a, f=f: materialise(f(*a), "test") for name, f in stages.items()}
    good = stages["quality classifier"](spark, docs, sf_dir)
    assert good.columns == columns and 0 < good.count() < before
    kept = good.toPandas()
    single = stages["n-gram Jaccard join"](spark, good, sf_dir)
    assert single.columns == columns
    group, _ = zip(*brute_classes(kept.text.tolist()), strict=True)
    first = kept.assign(group=group).sort_values("doc_id").drop_duplicates("group")
    assert sorted(single.select("doc_id").toPandas().doc_id) == sorted(first.doc_id)
    clean = stages["benchmark decontamination"](spark, single, sf_dir)
    bench = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert clean.columns == columns and not any(b in " ".join(re.findall(r"\w+", t.lower())) for t in clean.toPandas().text for b in bench)
    mix = stages["mixing sources to target weights"](spark, clean, sf_dir)
    assert mix.columns == columns and mix.select("doc_id").distinct().count() <= clean.count()
    words = lambda df: df.select(F.sum(mixing.text_size(F.col("text")))).first()[0]
    assert abs(words(mix) - 1.5 * words(clean)) < 0.2 * words(clean)
    out = stages["token-ID / binary output"](spark, mix, sf_dir)
    assert out.count() == mix.count()


def test_pipeline_of_nothing(spark, tmp_path):
    empty = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
