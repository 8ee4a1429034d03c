import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import LONG, awkward, prose, row, table
from pyarrow import fs
from tokenizers import Tokenizer, models

from relspark.llm import packed_ids, sentence_pieces, token_counts
from relspark.llm.byte_pairs import Encoder
from relspark.llm.words import runs

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as file:
        return file.read()


def odd_texts(n, seed=0):
    r = random.Random(seed)
    signs = list("abc def'st ll re  \n\t12.,!?éüñ漢字🙂\xa0 　 \x1c'_-%$▁") + ["<|endoftext|>", "'s", " ", "  ", "don't", "ABC", "ther"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


# --- packed ids ------------------------------------------------------------------------------


def test_encoder_is_the_library(library):
    with open(BPE, "rb") as file:
        encoder = Encoder(file.read())
    special = "<|endoftext|>"
    texts = odd_texts(4000) + [r[1] or "" for r in awkward()]
    texts += [special, f"hello {special} world", f"a  {special}{special}  b", f"x{special}y", special[:-1], special[1:]]
    texts += ["ab <|endof", "text|> cd", f"<|{special}|>", f"\n\n{special}\n", special[:-1] + " " + special]
    for _ in range(2):  # the second time words are remembered
        ids, before = encoder.encode(pa.array(texts))
        for text, a, b in zip(texts, before, before[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []
    assert encoder.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    for n in (0, 1, 7, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        packed = packed_ids.pack(ids, bits)
        assert len(packed) == -(-n * bits // 8)
        assert packed_ids.unpack(packed, bits, n).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [15, 16])
def test_random_access(tmp_path, bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 3 * packed_ids.BLOCK + 77).astype(np.uint32)
    path = str(tmp_path / "x.ids")
    with fs.LocalFileSystem().open_output_stream(path) as out:
        writer = packed_ids.FileWriter(out, bits)
        for part in np.array_split(ids, 5):
            writer.add(np.array([len(part)]), np.array([True]), np.array([len(part)]), part)
        assert writer.close() == (5, len(ids))
    with fs.LocalFileSystem().open_input_file(path) as source:
        reader = packed_ids.FileReader(source)
        for a, b in ((0, len(ids)), (5, 6), (packed_ids.BLOCK - 1, packed_ids.BLOCK + 1), (49_000, 49_300), (9, 9)):
            assert reader.read(a, b).tolist() == ids[a:b].tolist()
        assert reader.documents_table()[2][-1] == len(ids)
    with open(path, "ab") as file:
        file.write(b"cut")
    with fs.LocalFileSystem().open_input_file(path) as source, pytest.raises(ValueError):
        packed_ids.FileReader(source)


def test_write_and_read_in_id_order(spark, library):
    docs = awkward()
    folder = packed_ids.new_folder(spark)
    files = packed_ids.write_ids(table(spark, docs), folder, BPE)
    got = packed_ids.read_ids(files, with_ids=True).collect()
    expected = Counter()
    for r in docs:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected[r[0], tuple(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.ids_crc32) for r in got) == expected
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)


def test_empty_table(spark):
    files = packed_ids.write_ids(table(spark, []), packed_ids.new_folder(spark), BPE)
    assert packed_ids.read_ids(files).count() == 0


# --- pieces ----------------------------------------------------------------------------------


def split(ids, before):
    return [ids[a:b].tolist() for a, b in zip(before, before[1:], strict=False)]


def test_bpe_ids_are_the_library_s(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = sentence_pieces.Vocabulary(model)
    assert pieces.kind == sentence_pieces.BPE
    texts = odd_texts(3000, 1) + [r[1] or "" for r in awkward()]
    expected = library.encode(texts)
    assert split(*pieces.encode_all(texts)) == expected  # words side by side
    for text, ids in zip(texts, expected, strict=True):
        assert pieces.encode(text).tolist() == ids  # remembered words
    for text, ids in list(zip(texts, expected, strict=True))[:1500] + [(LONG, library.encode(LONG))]:
        streamed = pieces.searched(iter(library.normalize(text)))
        assert np.frombuffer(streamed, np.int32).tolist() == ids  # character by character
        assert pieces.decode(ids) == library.decode(ids)
    flat, before = pieces.encode_all(texts)
    assert pieces.decode_all(flat, before[:-1]) == [library.decode(ids) for ids in expected]


def test_unigram_search_finds_the_best_sum(model):
    """The same pieces as a unigram model; the library adds in single precision, so sums are compared."""
    unigram = model + b"\x12\x02\x18\x01"
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    pieces = sentence_pieces.Vocabulary(unigram)
    assert pieces.kind == sentence_pieces.UNIGRAM
    texts = [t for t in (prose(i, 30) for i in range(60))]

    def total(ids):
        return sum(library.get_score(i) for i in ids)

    for text, ids in zip(texts, split(*pieces.encode_all(texts)), strict=True):
        assert total(ids) >= total(library.encode(text))
        assert np.frombuffer(pieces.searched(library.normalize(text)), np.int32).tolist() == ids
        assert library.decode(ids) == text


def best_sum(pieces, text):
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        sums = [best[s] + pieces.scores[text[s:end]] for s in range(end) if text[s:end] in pieces.scores]
        best[end] = max(sums, default=None) if sums else best[end - 1] + pieces.unknown_score
    return best[-1]


def test_unigram_brute_force(model):
    pieces = sentence_pieces.Vocabulary(model + b"\x12\x02\x18\x01")
    for i in range(100):
        text = "▁" + prose(i, 3).replace(" ", "▁")
        found = list(pieces.stream(text))
        assert "".join(c for _, c in found) == text
        total = sum(pieces.unknown_score if own < 0 else pieces.score_of[own] for own, _ in found)
        assert total == pytest.approx(best_sum(pieces, text))


def test_the_window_stays_small(model):
    """Pieces are given out while the text is still coming."""
    pieces = sentence_pieces.Vocabulary(model)
    read = 0

    def characters():
        nonlocal read
        for char in "▁" + "xqzjkw" * 20_000:
            read += 1
            yield char

    behind, given = 0, 0
    for _, text in pieces.stream(characters()):
        behind = max(behind, read - given)
        given += len(text)
    assert given == read == 120_001 and behind < 200


def test_documents(spark):
    docs = awkward()
    got = sentence_pieces.encoded_documents(table(spark, docs), PIECES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = Counter((r[0], tuple(library.encode(r[1] or ""))) for r in docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    assert all(r.n_ids == len(r.ids) for r in got)
    assert all(r.round_trip != ("▁ odd" in (dict((d[0], d[1]) for d in docs)[r.doc_id] or "")) for r in got)
    assert sentence_pieces.encoded_documents(table(spark, []), PIECES).count() == 0


def test_decoding_null_ids(spark):
    model = sentence_pieces.shared_model(spark, PIECES)
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 450, None]), (4, [450])], "k int, ids array<int>")
    got = {r.k: r.t for r in lists.select("k", sentence_pieces.text_of_ids(lists.ids, model).alias("t")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got == {1: "", 2: "", 3: library.decode([450]), 4: library.decode([450])}


# --- counts ----------------------------------------------------------------------------------


def greedy(word, starts, others):
    at = count = 0
    while at < len(word):
        known = others if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


def test_automaton_like_greedy_matching():
    r = random.Random(2)
    for _ in range(60):
        pool = ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 25))]
        starts, others = set(r.sample(pool, r.randint(0, len(pool)))), set(r.sample(pool, r.randint(0, len(pool))))
        automaton = token_counts.Automaton(starts, others)
        for _ in range(150):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 14)))
            assert automaton.pieces(word) == greedy(word, starts, others)


def test_automaton_like_a_word_piece_library(model):
    starts, others = token_counts.word_pieces(model)
    vocabulary = {p: i for i, p in enumerate(["[UNK]", *dict.fromkeys(starts), *("##" + p for p in dict.fromkeys(others))])}
    library = models.WordPiece(vocab=vocabulary, unk_token="[UNK]", max_input_chars_per_word=1000)
    automaton = token_counts.automaton_of(model)
    for word in set(prose(7, 400).split()):
        found = [t.value for t in library.tokenize(word)]
        assert automaton.pieces(word) == (0 if "[UNK]" in found else len(found))


def test_counts_of_documents(spark, model):
    docs = awkward()
    starts, others = map(set, token_counts.word_pieces(model))

    def brute(text):
        found = re.findall(r"[a-zA-Z0-9\x80-\U0010ffff]+|[!-~]", text or "")
        pieces = [greedy(w, starts, others) for w in found]
        return len(found), sum(max(1, p) for p in pieces), sum(p == 0 for p in pieces)

    got = token_counts.token_counts(table(spark, docs), PIECES).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *brute(r[1])) for r in docs)
    assert token_counts.token_counts(table(spark, []), PIECES).count() == 0
    assert token_counts.token_counts(table(spark, [row(1, None)]), PIECES).collect()[0][1:] == (0, 0, 0)


def test_what_encoding_takes_for_a_while_is_bounded():
    """Two megabytes of text at once took more of every worker than an executor with many partitions has."""
    with open(BPE, "rb") as file:
        encoder = Encoder(file.read())
    texts = pa.array([" ".join(f"word{i % 50}" for i in range(2000))] * 300)
    sizes = []
    tracemalloc.start()
    for _, some in runs(texts, packed_ids.SLICE_BYTES):
        sizes.append(len(encoder.encode(some)[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) > 4 and len(set(sizes[1:-1])) <= 2
    assert peak < 10 << 20
