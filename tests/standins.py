"""Models for tests: an embedding and a chat model that need no service."""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle

from gapscope.models import ChatFn, EmbedFn

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


def hashed_bag_of_words(dim: int = 64) -> EmbedFn:
    """Stand-in embedding for tests: words hashed into ``dim`` buckets, length one."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in re.findall(r"\w+", text.lower()):
                v[int(hashlib.md5(word.encode()).hexdigest(), 16) % dim] += 1.0
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out

    return run


def canned_replies(replies: Sequence[dict | str]) -> ChatFn:
    """Stand-in chat model for tests: the prompt's hash picks one of the replies."""
    ready = [r if isinstance(r, str) else json.dumps(r) for r in replies]

    def run(prompt: str) -> str:
        return ready[int(hashlib.md5(prompt.encode()).hexdigest(), 16) % len(ready)]

    return run
