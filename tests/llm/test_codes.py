"""Token files, sampled pieces and chat formatting: exact round trips."""

import functools
import hashlib
import os
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import ROWS, TOKENIZERS, documents, empty
from webloom.llm import chat_format, huffman, pieces, queries, token_files
from webloom.llm.words import large_slices

WORD_BPE, PIECES = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
has_tokenizers = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="tokenizer files are not here")


@given(st.lists(st.integers(0, 300), max_size=400), st.integers(9, 20))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, bits):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301), bits)
    assert lengths.max(initial=0) <= bits
    packed, marks = huffman.pack(ids, huffman.canonical_codes(lengths), lengths)
    assert (huffman.Decoder(lengths).unpack(packed, marks, len(ids)) == ids).all()


def test_huffman_is_optimal_and_limited():
    import heapq

    counts = np.random.default_rng(3).zipf(1.5, 500)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 40) * counts).sum()) == cost
    lengths = huffman.code_lengths(2 ** np.arange(40), 8)
    assert lengths.max() == 8 and (2.0 ** -lengths.astype(float)).sum() <= 1


@has_tokenizers
def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = [*ROWS, (20, "Foo,bar.Baz).. Don't A!? é. İ. <|endoftext|>. <|ENDOFTEXT|>", "en", "a"), (21, "a\x1cb\x85c", "en", "a")]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = token_files.token_files(documents(spark, rows), WORD_BPE).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == start
        start += row["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    assert token_files.token_files(empty(spark), WORD_BPE).count() == 0


@has_tokenizers
def test_runs_of_letters_are_asked_for_once():
    """Capitals and closing punctuation of any kind make no new units, and ids stay those of whole texts."""
    encoder = token_files._WordEncoder(WORD_BPE)
    texts = ["Theandble*** theandble&&& THEANDBLE. theandble", "ÉTRE### étre e\u0301tre", None, "", " \n ",
             "İa a\u0301. x<|endoftext|> <|startoftext|>y don't 'Tis a=\u0338b ß%% \u00aab\u00ba ÿ Σας \u212a café\u0301",
             "10.2.3.4 a_b x-y... (the) \u00a0nbsp \x1c日本語。 …!? µm Ǆx ŒUVRE"]
    asked = token_files._units(token_files.split_words(pa.array(texts[:1]))[0])[0].to_pylist()
    assert sorted(asked) == ["", "&&&", "***", ".", "theandble"]
    for part in (texts, texts[2:5], [], texts[::-1]):
        ids, ends = encoder.encode(pa.array(part, pa.string()), 1)
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in part]
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want
    sliced, ends = encoder.encode(pa.array(texts).slice(1, 4), 1)
    assert [len(x) for x in np.split(sliced, ends)[:-1]] == [
        len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts[1:5]]


@functools.cache
def word_encoder():
    return token_files._WordEncoder(WORD_BPE)


@has_tokenizers
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5),
       st.lists(st.sampled_from(["The", "é", "É", "\u0301", "'s", "'", "***", ".", " ", "<|endoftext|>", "1", "ß", "İ"]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(texts, chosen):
    encoder, texts = word_encoder(), [*texts, "".join(chosen)]
    ids, ends = encoder.encode(pa.array(texts, pa.string()), 1)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [
        [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@has_tokenizers
def test_pieces_are_lossless(spark):
    got = pieces.round_trip(documents(spark), PIECES).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    assert {r["decoded_sha256"] for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS}
    assert pieces.round_trip(empty(spark), PIECES).count() == 0


@has_tokenizers
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
@settings(max_examples=40, deadline=None)
def test_pieces_of_any_text(texts):
    model = pieces._model(PIECES, 0.5)
    ids, ends = model.sample(pa.array(texts, pa.string()), np.arange(len(texts)))
    assert model.decode(ids, np.concatenate([[0], ends])) == texts


@has_tokenizers
def test_draws_follow_the_lattice():
    """Shares of sampled segmentations of a short word against all its segmentations, and seeds."""
    model = pieces.Lattice(PIECES, 0.5)
    word = " then"

    def paths(text):
        if not text:
            return {(): 1.0}
        found = {}
        for n in range(1, len(text) + 1):
            hit = model.weight.get(text[:n])
            if hit:
                for tail, weight in paths(text[n:]).items():
                    found[(hit[0], *tail)] = weight * hit[1]
        return found

    want = paths(word)
    total, n = sum(want.values()), 40_000
    texts = pa.array([word[1:]] * n)
    ids, ends = model.sample(texts, np.arange(n))
    begins = np.concatenate([[0], ends[:-1]])
    seen = {}
    for a, b in zip(begins, ends):
        seen[tuple(ids[a:b])] = seen.get(tuple(ids[a:b]), 0) + 1
    assert set(seen) <= set(want)
    assert all(abs(seen.get(p, 0) / n - w / total) < 0.015 for p, w in want.items())
    again, _ = model.sample(texts.slice(100, 50), np.arange(100, 150))
    assert (again == ids[begins[100]:ends[149]]).all()


@has_tokenizers
def test_memory_of_a_worker_is_bounded():
    """What a worker holds beside its input while it encodes and decodes 1 MB of words that hardly repeat."""
    letters = np.random.default_rng(5).integers(97, 123, (64, 1 << 14), np.uint8)
    letters[:, ::9] = 32
    texts = pa.RecordBatch.from_arrays([pa.array([row.tobytes().decode().strip() for row in letters])], ["text"])
    model, at = pieces.Lattice(PIECES, 0.5), 0
    tracemalloc.start()
    for part in large_slices(iter([texts]), 0, pieces.SLICE_BYTES):
        ids, ends = model.sample(part.column(0), np.arange(at, at + part.num_rows))
        assert model.decode(ids, np.concatenate([[0], ends])) == part.column(0).to_pylist()
        at += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == 64 and peak < 130e6


@has_tokenizers
def test_no_python_step_per_stretch():
    """Calls while a slice of 20,000 different words is sampled: they follow the slices, not the words."""
    letters = np.random.default_rng(6).integers(97, 123, (20, 8000), np.uint8)
    letters[:, ::8] = 32
    texts = pa.array([row.tobytes().decode() for row in letters])
    model, calls = pieces.Lattice(PIECES, 0.5), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    ids, ends = model.sample(texts, np.arange(20))
    sys.setprofile(None)
    assert model.decode(ids, np.concatenate([[0], ends])) == texts.to_pylist()
    assert calls < 5000


@has_tokenizers
def test_long_stretches_follow_the_same_lattice():
    model = pieces.Lattice(PIECES, 0.5)
    text = "thenotherinternational" * 4
    ids, ends = model.sample(pa.array([text] * 3), np.array([1, 2, 1]))
    first, second, third = np.split(ids, ends[:-1])
    assert (first == third).all() and first.tolist() != second.tolist()
    assert model.decode(ids, np.concatenate([[0], ends])) == [text] * 3


roles = st.sampled_from(["user", "assistant", "system", "tool", "", " [AS] x", "[ROLE]"])
parts = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "[", "<", " ", "/", "a", "]", ">", "INST", "\n", "s"]), max_size=12)


@given(roles, parts)
@settings(max_examples=400, deadline=None)
def test_turns_read_back(role, chosen):
    text = "".join(chosen)
    formatted, a, b = chat_format.render_turn(role, text)
    assert chat_format.parse_turn(formatted) == (role, text)
    assert chat_format.unescape(formatted[a:b]) == (text if role == "assistant" else "")


def test_plain_turns_stay_plain():
    assert chat_format.render_turn("user", "a <b> [c] \\") == ("[INST] a <b> [c] \\ [/INST]", 0, 0)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "b </s>"),
            (3, None, "user", "late"), (3, 5, "assistant", "y" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS formatted")
    got = {r["conv_id"]: r for r in chat_format.chat_format(table).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb </s>\nassistant\nb </s>\n").hexdigest()
    assert got[1]["loss_chars"] == 12 and got[3]["loss_sha256"] == hashlib.sha256(b"y" * 200_000).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert chat_format.chat_format(table.filter("false")).count() == 0


def test_conflicting_conversation(spark):
    row = {r["conv_id"]: r for r in chat_format.chat_format(spark.sql(queries.CONFLICT).toDF("conv_id", "turn", "role", "text")).collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
