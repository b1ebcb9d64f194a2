import sys
from pathlib import Path

import pytest

from galley.llm import bpe

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, public_tokenizers.PATTERN, own
