"""SentencePiece codec, prefix token counts and language ID against the libraries and by definition."""

import collections
import hashlib
import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lossledger.llm import langid, registry
from lossledger.llm.merging import merge_joined, merge_pairs
from lossledger.llm.sentencepiece_codec import CharacterMap, Normalizer, encode, encode_digests, piece_model
from lossledger.llm.token_counts import token_counter, token_counts

from .cases import AWKWARD, documents, rows

sentencepiece = pytest.importorskip("sentencepiece")
SMALL = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "  ", " ", "the", " of", "ß", "é", "日本", "▁", "\n", "\t", "😀", "​", "́", "<s>", "<0x41>", "0", "12", "▁▁", "\x00", "ﬁ",
            "Ⅷ", "　", "\xa0", "\x85", "\x1c", "<|endoftext|>", "'s", "'ll", "...", "�"]


def fuzz(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 30))) for _ in range(n)] + ["x" * 4000 + " " * 300, " ", "", "a ", " a", "▁", "▁ a"]


def table_texts():
    return pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.PIECES)


def test_codec_equals_the_library(library):
    model = piece_model(registry.PIECES)
    for text in fuzz(1500) + table_texts()[:60]:
        ids, starts, ends, back = model.encode_and_decode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert back.decode() == library.decode(want) == model.decode(want)
        assert np.frombuffer(ids, "<u4").tolist()[1:-1] == model.encode(text)[0].tolist()


def test_spans_equal_the_library_and_cover_the_text(library):
    model = piece_model(registry.PIECES)
    for text in fuzz(300, 6):
        _, starts, ends = model.encode(text)
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert b"".join(text.encode()[a:z] for a, z in zip(starts, ends)) == text.encode()


def test_decode_of_arbitrary_ids_equals_the_library(library):
    model, r = piece_model(registry.PIECES), random.Random(7)
    for _ in range(300):
        ids = [r.randrange(3, 300) if r.random() < 0.6 else r.randrange(32000) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_character_map_normalises_like_the_library():
    for collapse in (True, False):
        n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=collapse)
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(n.serialized_model_proto())
        own = Normalizer(CharacterMap(proto.normalizer_spec.precompiled_charsmap), True, collapse, True)
        for text in fuzz(400, 8):
            normal, origin = own(text)
            assert normal == n.normalize(text)
            assert len(origin) == len(normal.encode()) + 1 and list(origin) == sorted(origin) and origin[-1] <= len(text.encode())


def test_codec_over_awkward_rows(spark, library):
    df = documents(spark, AWKWARD)
    got = sorted(rows(encode_digests(df, registry.PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"), key=str)
    want = []
    for i, text in AWKWARD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(),
                     len((text or "").encode())))
    assert got == sorted(want, key=str)
    assert {(r["doc_id"], r["decoded"]) for r in rows(encode(df, registry.PIECES))} == {(i, t or "") for i, t in AWKWARD if "▁" not in (t or "")} | {(8, AWKWARD[8][1].replace("▁", " "))}
    assert encode_digests(df.limit(0), registry.PIECES).count() == 0


def test_long_and_short_merges_agree():
    r = random.Random(1)
    rank = {(a, b): r.random() for a, b in itertools.product(["a", "b", "ab", "ba", "aa"], repeat=2)}
    joined = {a + b: rank[a, b] for a, b in reversed(list(rank))}
    from lossledger.llm.merging import _merge_long

    for _ in range(300):
        parts = r.choices("ab", k=r.randint(1, 40))
        assert merge_pairs(parts, rank) == _merge_long(parts, lambda a, b: rank.get((a, b)))
        assert merge_joined(parts, joined) == _merge_long(parts, lambda a, b: joined.get(a + b))


def test_token_counts_equal_the_library_at_every_prefix():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(registry.BYTE_BPE), token_counter(registry.BYTE_BPE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in fuzz(800, 9) + table_texts()[:40]:
        assert own.count(text) == own.table(text).total() == count(text)
    for text in fuzz(60, 10)[:60]:
        table = own.table(text)
        assert [table.at(p) for p in range(len(text) + 1)] == [count(text[:p]) for p in range(len(text) + 1)]
        offsets = [len(text[:b].encode()) for _, b in library.encode(text, add_special_tokens=False).offsets]
        for limit in (0, 1, 3, 1000):
            cut = table.cut(limit)
            assert own.count_and_cut(text, limit) == (table.total(), cut)
            assert cut <= len(text.encode()) and (limit < len(offsets) or cut == len(text.encode()))


def test_token_counts_over_awkward_rows(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(registry.BYTE_BPE)
    df = documents(spark, AWKWARD)
    got = sorted(rows(token_counts(df, registry.BYTE_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit"), key=str)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted([(i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in AWKWARD], key=str)
    assert token_counts(df.limit(0), registry.BYTE_BPE).count() == 0


def test_forward_sums_all_segmentations():
    pieces = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.3, 0.3), "b": (0.05, 0.1), "ab": (0.25, 0.1), "▁ab": (0.1, 0.2), "ba": (0.07, 0.01)}
    scorer = langid.Scorer(("x", "y"), pieces)

    def brute(word, k):
        if not word:
            return 1.0
        return sum((pieces.get(word[:i]) or ((langid.STRANGE,) * 2 if i == 1 else (0.0, 0.0)))[k] * brute(word[i:], k) for i in range(1, len(word) + 1))

    for group in (["▁a"], ["▁ab", "▁ba", "▁za"], ["▁abba"], ["▁babab", "▁ababa", "▁zzzab"], ["▁" + "z" * 40, "▁" + "ab" * 20]):
        for word, logs in zip(group, scorer.logs(group)):
            if len(word) < 10:
                assert logs.tolist() == pytest.approx([math.log(brute(word, k)) for k in (0, 1)])
            assert logs.tolist() == pytest.approx(scorer._scaled(word))


def test_expected_counts_by_enumeration():
    prob = {"a": 0.3, "ab": 0.4, "b": 0.2, "ba": 0.1}
    lattice = langid.Lattice(prob)
    cuts = [["a", "b", "a"], ["ab", "a"], ["a", "ba"]]
    weight = [math.prod(prob[p] for p in c) for c in cuts]
    want = {p: sum(w * c.count(p) for c, w in zip(cuts, weight)) / sum(weight) for p in prob}
    got = langid.expected_counts({"aba": 2}, lattice, np.array([prob[p] for p in lattice.pieces] + [langid.STRANGE]))
    assert dict(zip(lattice.pieces, got)) == pytest.approx({p: 2 * want[p] for p in prob})


def test_predictions_equal_a_plain_version(spark):
    """All rows of op2 against a version without numpy, hashing or grouping: dictionaries, one word and one edge at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = documents(spark, [(10_000 + i, t) for i, (_, t) in enumerate(AWKWARD)]).select(*docs.columns)
    df = docs.unionByName(extra)
    found = {r["doc_id"]: r for r in rows(langid.identify(df, registry.PIECES, most=10_000))}
    pieces = langid.piece_list(registry.PIECES)

    def plain_words(text):
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        return ["▁" + w[i:i + 64] for w in letters.split() for i in range(0, len(w), 64)]

    def edges(word):
        return [(i, j, word[i:j]) for i in range(len(word)) for j in range(i + 1, min(len(word), i + 20) + 1) if j == i + 1 or word[i:j] in pieces]

    all_rows = rows(df, "doc_id", "text", "lang")
    counts = {}
    for i, text, lang in all_rows:
        if lang is not None and text is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, collections.Counter()).update(plain_words(text))
    lattices = {w: edges(w) for c in counts.values() for w in c}
    models = {}
    for lang, words in counts.items():
        prob = {p: 30.0 ** -len(p) for p in pieces}
        for _ in range(2):
            seen = collections.Counter()
            for w, times in words.items():
                f, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
                for i, j, p in lattices[w]:
                    f[j] += f[i] * prob.get(p, langid.STRANGE)
                for i, j, p in reversed(lattices[w]):
                    b[i] += b[j] * prob.get(p, langid.STRANGE)
                for i, j, p in lattices[w]:
                    seen[p] += f[i] * prob.get(p, langid.STRANGE) * b[j] * times / f[-1] if f[-1] else 0.0
            total = sum(seen.values()) + 0.05 * len(pieces)
            prob = {p: (seen.get(p, 0.0) + 0.05) / total for p in pieces}
        models[lang] = prob
    known = {}

    def log_p(word, lang):
        if (word, lang) not in known:
            f = [0.0] + [-math.inf] * len(word)
            for i, j, p in lattices.get(word) or edges(word):
                f[j] = np.logaddexp(f[j], f[i] + math.log(models[lang].get(p, langid.STRANGE)))
            known[word, lang] = f[-1]
        return known[word, lang]

    assert len(found) >= len(all_rows) - 2  # AWKWARD's ids were renumbered, so none repeats
    for i, text, _ in all_rows:
        words = plain_words(text)
        if not words:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        sums = {lang: sum(log_p(w, lang) for w in words) for lang in sorted(models)}
        best = max(sums, key=sums.get)
        assert found[i]["lang_pred"] == best
        assert found[i]["score"] == pytest.approx(1 / sum(math.exp(x - sums[best]) for x in sums.values()), abs=1e-6)


def test_numerals_are_no_letters(spark):
    texts = ["²³", "½", "Ⅷ", "①", "the and of"]
    df = documents(spark, texts, langs=[None, None, None, None, "en"])
    assert [r[1] for r in sorted(rows(langid.identify(df, registry.PIECES), "doc_id", "lang_pred"))] == ["und"] * 4 + ["en"]


def test_language_is_found_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = dict(rows(docs, "doc_id", "lang"))
    found = rows(langid.identify(docs, registry.PIECES, most=300))
    assert len(found) == len(truth) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_cases(spark):
    texts = ["der die und nicht das", "the of and to in that", "the and of by was it", "und der ist nicht von", None, "12 !? 3", "", "the of and " + "x" * 5000] * 3
    langs = ["de", "en", "en", "de", "en", None, "de", None] * 3
    df = documents(spark, [*texts, (None, "the and of")], langs=[*langs, "en"])
    found = {r["doc_id"]: r for r in rows(langid.identify(df, registry.PIECES))}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert found[0]["lang_pred"] == "de" and found[1]["lang_pred"] == found[None]["lang_pred"] == "en"
    kept = rows(langid.keep_identified(df, registry.PIECES))
    assert {r["doc_id"] for r in kept} == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.5} and set(kept[0]) == set(df.columns)
    blind = documents(spark, texts)  # no label anywhere
    assert {r["lang_pred"] for r in rows(langid.identify(blind, registry.PIECES))} == {"und"}
    assert langid.identify(df.limit(0), registry.PIECES).count() == 0


def test_every_language_is_learned_at_any_size(spark):
    """A language with a thousandth of the rows gets training documents; a tiny share of many rows still chooses some."""
    texts = [("the and of by was it", "en")] * 4000 + [("und der ist nicht von", "de")] * 4
    df = documents(spark, [t for t, _ in texts], langs=[x for _, x in texts])
    training = lambda d, most: {(r["lang"], r["word"]): r["n"] for r in rows(langid.training_words(d, "doc_id", "text", "lang", most))}
    counts = training(df, 40)
    assert counts["de", "▁und"] >= 1 and 10 <= counts["en", "▁the"] <= 120
    assert langid.hash_limits({"en": 1 << 50, "de": 2000, "fr": 1999, "es": 2001}, 2000) == {"en": 2000 << 13, "es": (2000 << 63) // 2001}
    # More than 2^20 usable rows for each one to choose.
    many = spark.range(6_000_000).select(F.col("id").alias("doc_id"), F.lit("the of").alias("text"), F.lit("en").alias("lang"))
    assert 0 < training(many, 4)["en", "▁the"] <= 20


def test_words_are_dropped_at_a_tasks_end():
    from lossledger.llm.registry import PIECES
    from lossledger.llm.sentencepiece_codec import PieceModel, forgetting
    model = PieceModel(PIECES)
    rows = list(forgetting(model, (model.encode_and_decode(t) for t in ["alpha beta", "gamma漢字"])))
    assert len(rows) == 2 and not model.words and not model.atoms


def test_known_pairs_merge_alike():
    from lossledger.llm.merging import merge_joined
    rank = {"ab": 1, "bc": 1, "abc": 2, "cab": 0, "aa": 3, "aab": 4, "aaaa": 5}
    pairs = {(p[0], p[1]): r for p, r in rank.items() if len(p) == 2}
    for text in ("", "a", "abc", "aabca", "aaaaa", "cabcab", "xaby", "aab" * 10, "aab" * 30):
        assert merge_joined(text, rank, pairs) == merge_joined(list(text), rank)
