"""Classifiers by held-out accuracy and edge cases; token counts against the library."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from loamspark.llm import queries_models, rule_ensemble, toxicity, viterbi_counts

SF = "/root/testdata/sf0.01"
#: Toxic words are many and rare; the smaller tables hold too few of them to learn.
SF_LARGER = "/root/testdata/sf0.1"


def accuracy(spark, query, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    return rows, sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark):
    rows, share = accuracy(spark, queries_models.op4_rule_ensemble, "quality")
    assert share >= 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    rows, share = accuracy(spark, queries_models.op8_toxicity, "toxic", SF_LARGER)
    assert share >= 0.97 and all(0 <= r["score"] <= 1 for r in rows)


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "word " * 50), (5, "x" * 20_000), (5, "x"), (None, "no id"), (6, "$$$ 1d10t")]


def test_classifiers_on_edge_tables(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'y' as label", "1 as score", "2 as total", "3 as bucket")
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(4, 1), (5, 1), (4, None)], "doc_id long, label int")
    both = spark.createDataFrame([(4, 1), (5, 0), (2, 0), (4, 1)], "doc_id long, label int")
    for labels in (none, one, both):
        for found in (rule_ensemble.classify_quality(docs, labels), toxicity.classify_toxicity(docs, labels)):
            rows = found.collect()
            assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert rule_ensemble.classify_quality(docs.limit(0), none).count() == 0
    assert toxicity.classify_toxicity(docs.limit(0), none).count() == 0


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = rule_ensemble.fit_rules(x, y)
    assert 0 < len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{s} double" for s in rule_ensemble.STATISTICS))
    scores = np.array([r[0] for r in df.select(model.score()).collect()])
    assert ((scores >= 0.5) == (y[:200] == 1)).mean() > 0.95
    assert model.describe()


def test_deobfuscation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    restorer = toxicity.Restorer(toxicity.character_model(docs))
    for hidden, plain in {"1d10t": "idiot", "m0r0n": "moron", "idiooooot": "idiot", "i d i o t": "idiot", "$tupid": "stupid", "l0ser!": "loser", "c.l.o.w.n": "clown"}.items():
        assert plain in restorer.restore(f"the {hidden} and").split(), hidden
    assert restorer.words("plain") == ["plain"] and restorer.words("2024") == ["2024"]


def test_long_obfuscated_text_is_scored(spark):
    """Spaced letters over 256 characters, tokens over 64 and runs of look-alikes."""
    model = toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))
    restorer = toxicity.Restorer(model, lambda buckets: set(buckets))
    found = lambda text: set().union(*restorer.of_text(text)[1])
    has = lambda word, text: bool(set(toxicity.buckets_of(word)) & found(text))
    spaced, junk = " ".join("youareanidiotandaclown" * 12), " ".join("xqzvk" * 60)
    token = ".".join("stupid" + "xqzvk" * 12)
    assert len(spaced) > 256 and len(junk) > 256 and len(token) > 64
    assert has("idiot", spaced) and has("clown", spaced)
    assert has("idiot", f"i d i o t {junk}") and has("stupid", token)
    assert has("idiot", "idi000t") and has("clown", "cl0000wn")
    assert has("skill", "sk111")  # a run may still be three letters
    assert restorer.of_text(" ".join("ab" * 100_000))[0] == 200_000  # linear


def test_gram_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(1, "ab AB"), (2, None), (3, "")], "doc_id long, text string")
    counts = {r["gram"]: r["n"] for r in toxicity.gram_counts(docs).collect()}
    code = lambda s: sum("  abcdefghijklmnopqrstuvwxyz".replace("  ", " ", 1).index(c) * toxicity.SIZE ** (2 - i) for i, c in enumerate(s))
    assert counts == {code(" ab"): 2, code("ab "): 2, code("b a"): 1}


def library(pieces, has_bytes):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=has_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_counts_match_the_library():
    rnd = random.Random(2)
    real = viterbi_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    tied = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("ba", -2.0), ("▁a", -2.0)]
    for pieces, has_bytes, letters in ((real, True, "ab c▁é中文\n\t<0x41>unk😀ñ  tion"), (tied, False, "abaxy ")):
        count, ref = viterbi_counts.ViterbiCounter(pieces), library(pieces, has_bytes)
        for _ in range(1500):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
            assert count.count(text)[0] == ref(text), text


def test_count_query_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    rows = viterbi_counts.token_counts(df, path).collect()
    ref = library(viterbi_counts.load_pieces(path), True)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == sorted((i or -1, ref(t) if t else 0) for i, t in EDGES)
    assert viterbi_counts.token_counts(df.limit(0), path).count() == 0
    assert rows[0]["score"] == 0.0 and isinstance(F.lit(1), type(F.lit(2)))


def brute_statistics(text):
    """The statistics by plain loops."""
    text = text or ""
    words = text.split()
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    share = lambda some, of: sum(map(bool, some)) / max(of, 1)
    pairs = list(zip(words, words[1:], strict=False))
    kinds = sorted(set(words))
    return {
        "n_words": n,
        "word_length": sum(len(w) for w in words) / max(n, 1),
        "long_words": share((len(w) > 12 for w in words), n),
        "symbols": sum(c in "#*$%&<>=~^@\\{}[]" for c in text) / max(len(text), 1),
        "pipes": sum(c == "|" for c in text) / max(n, 1),
        "marks": sum(c in "!?" for c in text) / max(n, 1),
        "upper": share((w.isupper() for w in words), n),
        "digits": sum(c.isdecimal() for c in text) / max(len(text), 1),
        "commas": sum(c in ",." for c in text) / max(n, 1),
        "distinct_words": len(kinds) / max(n, 1),
        "top_word": max((words.count(w) for w in kinds), default=0) / max(n, 1),
        "same_neighbour": share((a == b for a, b in pairs), n),
        "repeated_pairs": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        "n_lines": len(lines),
        "line_words": n / max(len(lines), 1),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "no_letters": share((not any(c.isalpha() for c in w) for w in kinds), len(kinds)),
    }


TEXTS = [t for _, t in EDGES] + ["A b b, c.\nA b b, c.\n\n| 12 | x! WHY? {}", "ÉTÉ été 12 12 12 a b a b a b", "x"]


def test_statistics_and_rules_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as n_words", "1 as label")
    model = rule_ensemble.RuleModel(-0.25, ((((0, True, 3.0), (3, False, 0.2)), 1.5), (((16, True, 0.1),), -2.0)))
    measured = rule_ensemble.text_statistics(df).select("*", model.score().alias("score")).collect()
    for r in measured:
        want = brute_statistics(TEXTS[r["doc_id"]])
        assert {k: r[k] for k in want} == {k: float(v) for k, v in want.items()}
        line = -0.25 + (1.5 if want["n_words"] > 3 and want["symbols"] <= 0.2 else 0) - (2.0 if want["no_letters"] > 0.1 else 0)
        assert abs(r["score"] - 1 / (1 + np.exp(-line))) < 1e-12


def test_rules_without_a_split_give_the_prior():
    x = np.ones((9, len(rule_ensemble.STATISTICS)))
    y = np.array([1.0] * 3 + [0.0] * 6)
    model = rule_ensemble.fit_rules(x, y)
    assert not model.rules and abs(1 / (1 + np.exp(-model.intercept)) - 0.35) < 1e-9


def test_held_out_recall_and_precision(spark):
    """Accuracy alone would let pass a scorer that never finds anything."""
    rows, _ = accuracy(spark, queries_models.op8_toxicity, "toxic", SF_LARGER)
    hits = sum(r["predicted"] == r["toxic"] == 1 for r in rows)
    assert hits / sum(r["toxic"] == 1 for r in rows) >= 0.9 and hits / sum(r["predicted"] == 1 for r in rows) >= 0.9
    rows, _ = accuracy(spark, queries_models.op4_rule_ensemble, "quality", SF)
    bad = sum(r["predicted"] == r["quality"] == 0 for r in rows)
    assert bad / sum(r["quality"] == 0 for r in rows) >= 0.8


def test_decoding_matches_exhaustive_paths(spark):
    """The lattice decoder against every path, for short tokens."""
    import itertools

    model = toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))

    def spelled_score(parts):
        x = y = 0
        total = 0.0
        for text, cost in [*parts, (" ", 0.0)]:
            total += cost
            for ch in text:
                code = toxicity._CODE.get(ch, toxicity.OTHER)
                if code or y:
                    total += model.step(x, y, code)
                    x, y = y, code
        return total

    for token in ("1d10t", "$h1t", "a55", "cl0wn", "m0r0n", "b.a.d", "sooo", "x1y|", "l00ser"):
        lattice = toxicity.lattice_of(token)
        scored = [(spelled_score(path), "".join(t for t, _ in path).strip()) for path in itertools.product(*lattice)]
        best = max(s for s, _ in scored)
        got = model.decode(lattice)
        assert any(abs(s - best) < 1e-3 and t == got for s, t in scored), token


def test_bucket_counts_and_weights_match_brute_force(spark):
    model = toxicity.character_model(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [("you idiot clown", 1), ("idiot again", 1), ("a fine day", 0), (None, 0), ("idiot 1d10t", 1), ("clown fish", 0), ("idiot idiot", 1)]
    counts = toxicity.bucket_counts(spark.createDataFrame(rows, "text string, label int"), model)
    got = {r["bucket"]: (r["toxic"], r["clean"]) for r in counts.collect()}
    restorer, want = toxicity.Restorer(model), {-1: (4, 3)}
    for text, label in rows:
        for b in set().union(*restorer.of_text(text)[1]):
            t, c = want.get(b, (0, 0))
            want[b] = (t + label, c + 1 - label)
    assert got == want
    weights, toxic, clean = toxicity.bucket_weights(counts)
    odds = {b: np.log((t + 0.1) / 4.2) - np.log((c + 0.1) / 3.2) for b, (t, c) in want.items() if b >= 0 and t >= 4}
    assert (toxic, clean) == (4, 3)
    assert weights.keys() == {b for b, w in odds.items() if w >= 2.5} and all(abs(w - min(odds[b], 8.0)) < 1e-9 for b, w in weights.items())
