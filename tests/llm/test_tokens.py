"""Pre-tokens, token ids, packing, token files and byte-level BPE against the libraries and brute force."""
import base64
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex

from deltascope.llm import bitpack, bpe, packing, pretokens, token_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "\n\n", "It's we'll I'd 'tis '' 'S 'lx'", "a  b\t c\n", "日本語 текст ١٢ naïve é", "<|endoftext|> and <|endoftext|>", "x" * 3000, " ' 's !'s?", "a b  c", "word " * 2000,
    "tail   ", "1234567 89", "\U0001f600\U0001f600 ok", "it's" + "'s" * 40, "\r\n\r\n end", "é combining",
]


def rows(spark, texts=TEXTS):
    """Texts with a null one, a repeated row, a null id and columns whose names clash with the operators' own."""
    data = [(k, t, 7, "x") for k, t in enumerate(texts)] + [(900, None, 7, "x"), (3, texts[3], 7, "x"), (None, "no id", 7, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, start long, ids_crc32 string")


def empty(spark):
    return rows(spark).limit(0)


@functools.cache
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return tokenizer


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def random_texts(count, seed):
    rng = random.Random(seed)
    alphabet = [*"abst'revmdl 19 \n\t#!é日  "] + ["'s", "'ll", "  ", "\r\n", "'re"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(count)]


def test_pretokens_are_those_of_the_pattern():
    texts = TEXTS + random_texts(4000, 1)
    tokens, places = pretokens.split(pa.array(texts))
    tokens = tokens.to_pylist()
    for k, text in enumerate(texts):
        assert tokens[places[k] : places[k + 1]] == regex.findall(public_tokenizers.PATTERN, text)


def test_pretokens_of_a_slice():
    tokens, places = pretokens.split(pa.array(["zz", *TEXTS, "q"]).slice(1, len(TEXTS)))
    assert "".join(tokens.to_pylist()) == "".join(TEXTS) and len(places) == len(TEXTS) + 1


@pytest.mark.parametrize("most", [token_ids.KNOWN_PRETOKENS, 5])
def test_ids_are_the_librarys(most):
    encoder = token_ids.library_encoder(TOKENIZER)
    encoder.most = most
    texts = TEXTS + random_texts(300, 2)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        ids, bounds = encoder.encode(pa.array(part))
        for k, text in enumerate(part):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library_ids(text)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for count in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, count, dtype=np.uint64).astype(np.uint32)
        words = bitpack.pack(ids, bits)
        assert len(words) == -(-count // 64) * bits
        assert (bitpack.unpack(words, bits, count) == ids).all()


def test_random_access(tmp_path):
    ids = np.arange(10_000, dtype=np.uint32) % 777
    (tmp_path / "f").write_bytes(bitpack.file_bytes(ids, np.array([0, 5, 5, 10_000]), [1, None, 3], 10))
    file = bitpack.TokenFile(str(tmp_path / "f"))
    assert file.doc_ids == [1, None, 3]
    for a, b in [(0, 10_000), (4095, 4097), (9999, 10_000), (5, 5), (8192, 8200)]:
        assert (file.ids(a, b) == ids[a:b]).all()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path, monkeypatch):
    found = bitpack.read(bitpack.write(rows(spark), str(tmp_path), TOKENIZER, 50_257)).collect()
    source = sorted(((r.doc_id, r.text) for r in rows(spark).collect()), key=lambda x: (x[0] is not None, x[0]))
    start = 0
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [x[0] for x in source]
    for row, (_, text) in zip(sorted(found, key=lambda r: (r.start)), source):
        ids = [*library_ids(text), 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert bitpack.read(bitpack.write(empty(spark), str(tmp_path / "none"), TOKENIZER, 50_257)).count() == 0


def check_pieces(found, source, window=packing.WINDOW):
    texts = {}
    for r in source:
        texts.setdefault((r.doc_id, len(library_ids(r.text)) + 1), []).append([*library_ids(r.text), 0])
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        copies = texts[key]
        at = sorted((p.start, p.length) for p in pieces)
        assert sum(n for _, n in at) == key[1] * len(copies)
        if len(copies) == 1:
            assert [s for s, _ in at] == list(np.cumsum([0] + [n for _, n in at])[:-1])
            assert all(p.ids_crc32 == crc(copies[0][p.start : p.start + p.length]) for p in pieces)
    for pieces in by_sequence.values():
        offset = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == offset
            offset += p.length
        assert offset <= window


def test_packing(spark):
    found = packing.pack_documents(rows(spark), TOKENIZER).collect()
    check_pieces(found, rows(spark).collect())
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0
    many = spark.createDataFrame([(k, "ab c, " * (k % 90)) for k in range(1500)], "doc_id long, text string").coalesce(2)
    for most_open in (packing.OPEN_WINDOWS, 3):
        found = packing.pack_documents(many, TOKENIZER, window=64, most_open=most_open).collect()
        check_pieces(found, many.collect(), 64)
        tokens = sum(r.length for r in found)
        assert len({r.sequence_id for r in found}) <= tokens / 64 + 2  # one partly filled window in each of two tasks


def test_level_chosen_has_the_smallest_sum_of_squares():
    rng = random.Random(3)
    packer = packing.SquarePacker(32)
    for k in range(3000):
        size = rng.randint(1, 31)
        counts = packer.counts[1:32].tolist()

        def cost(level):
            after = dict(enumerate(counts, 1))
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return sum(v * v for v in after.values())

        options = [0] + [h for h in range(1, 32 - size + 1) if counts[h - 1]]
        assert cost(packer.level_for(size)) == min(map(cost, options))
        packer.add(k, np.zeros(size, np.uint32))
        assert packer.counts[32] == 0 and packer.counts.min() >= 0


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens(spark):
    encoding = tiktoken_encoding()
    texts = TEXTS + random_texts(400, 5) + ["ab" * 700 + "'" * 99 + "日本" * 60]
    source = rows(spark, texts).collect()
    digests = bpe.round_trip(rows(spark, texts), RANKS).collect()
    want = sorted(
        (str(r.doc_id), len(ids := encoding.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in source
    )
    assert sorted((str(r[0]), *r[1:]) for r in digests) == want
    coded = bpe.encode_documents(rows(spark, texts), RANKS)
    back = {(r.doc_id, bytes(r.data).decode()) for r in bpe.decode_documents(coded, RANKS).collect()}
    assert back == {(r.doc_id, r.text or "") for r in source}
    assert bpe.round_trip(empty(spark), RANKS).count() == 0
