"""Vocabulary files that the registered queries use; the operators take a path as a parameter."""
import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_SIZE = 50_257
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
