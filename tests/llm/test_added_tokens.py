"""Ids where a text holds an added token of the file, against the library as it is called without settings."""
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from deltascope.llm import token_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [
    "", "plain text", f"a {END} b", END, f"{END}{END}", f"é {END}\n\n{END}  x", "a <|endoftext| b", f"日本{END}'s", "it's " * 50, f" {END} ", "last",
]


def test_added_tokens_are_the_librarys():
    library, encoder = Tokenizer.from_file(TOKENIZER), token_ids.library_encoder(TOKENIZER)
    assert library.encode(TEXTS[2], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for texts in (TEXTS, TEXTS[:2], TEXTS[2:5], [END], []):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        assert len(bounds) == len(texts) + 1
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    column = pa.array(["zz", *TEXTS, "q"]).slice(1, len(TEXTS))
    assert encoder.encode(column)[0].tolist() == [i for t in TEXTS for i in library.encode(t, add_special_tokens=False).ids]
