"""Ids of a byte-level BPE vocabulary that is given twice: as a tokenizer file and as a table of ranks.

The tokenizer file decides. The rank table gives the same ids at a third of the time and serves texts below U+0240, for which both split
alike (tests compare them on every such character); other texts, and texts with a special token's string where that string counts, go through
the tokenizer itself.
"""

import base64
import json

import numpy as np

#: Bytes of UTF-8 below U+0240.
LOW = bytes(range(0xC9))


class ByteBpe:
    def __init__(self, tokenizer_path, ranks_path, special=True):
        import public_tokenizers
        import tiktoken

        self.path, self.special_counts, self._whole = tokenizer_path, special, None
        with open(tokenizer_path) as f:
            self.special = [t["content"].encode() for t in json.load(f)["added_tokens"]] if special else []
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def whole(self):
        """The tokenizer itself, read when a text needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = not self.special_counts
        return self._whole

    def ids(self, text, raw=None):
        """Ids of ``text`` as 32-bit numbers; ``raw``: its UTF-8 bytes, if at hand."""
        raw = text.encode() if raw is None else raw
        if raw.translate(None, LOW) or any(s in raw for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.ranked.encode_to_numpy(text)
