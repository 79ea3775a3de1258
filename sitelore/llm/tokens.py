"""Token ids of whole texts by the tokenizers library, with a per-worker cache of pieces.

The byte-level pre-tokenizer never joins a character that is not white space to the space behind it, so a text may be
cut in front of such a space and its pieces encoded apart. Words repeat, so each worker keeps the ids of up to
`CACHED` pieces, or of as many as the operator asks for; others are encoded as they come. Results equal those of encoding
the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from sitelore.llm.common import hold

#: pieces whose ids a worker keeps, and texts whose pieces are looked up at a time
CACHED, BATCH = 800_000, 512
_CUT = re.compile(r"(?<=\S)(?= )")
_ENCODERS: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian bytes: two bytes an id for vocabularies up to 65 536, else four."""

    def __init__(self, path: str, cached: int | None = None):
        self.cached = CACHED if cached is None else cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # the byte-level sign for a space
        # pieces behind a space, without it; all other pieces
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces that are a space and further characters are encoded as one text: every id whose
        token starts with a space then starts a piece."""
        plain = [p for p in pieces if len(p) > 1 and p[0] == " " and " " not in p[1:]]
        done: dict[str, bytes] = {}
        if plain:
            found = self.tokenizer.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0]  # without offsets
            ids = np.array(found.ids, self.kind)
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(plain):
                raw, size = ids.tobytes(), ids.itemsize
                cuts = [*(at * size).tolist(), len(raw)]
                done = {p: raw[a:b] for p, a, b in zip(plain, cuts, cuts[1:])}
        rest = [p for p in pieces if p not in done]
        for p, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            done[p] = np.array(x.ids, self.kind).tobytes()
        return [done[p] for p in pieces]

    def _add(self, cache: dict[str, bytes], asked: set[str], space: str) -> list[str]:
        """Encode the asked pieces that the cache lacks; what has to leave it after this batch."""
        new = list(asked.difference(cache))
        room = max(0, self.cached - len(cache))
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            cache.update(zip(part, self._encode([space + p for p in part])))
        return [p for k, p in enumerate(new) if k >= room or len(p) >= 40]

    def encode(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, with the end id appended."""
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        cache, heads = self.cache, self.heads
        find, find_head = cache.__getitem__, heads.__getitem__
        out: list[np.ndarray] = []
        for start in range(0, len(texts), BATCH):
            cut, words, firsts = [], set(), set()
            for t in texts[start:start + BATCH]:
                t = t or ""
                if "  " in t:
                    first, rest = _CUT.split(t), []
                    firsts.update(first)
                else:
                    rest = t.split(" ")
                    first = [rest[0]] if rest[0] else []
                    del rest[0]
                    firsts.update(first)
                    words.update(rest)
                cut.append((first, rest))
            leaving = [(c, self._add(c, asked, space)) for c, asked, space in ((cache, words, " "), (heads, firsts, ""))]
            for first, rest in cut:
                out.append(np.frombuffer(b"".join((*map(find_head, first), *map(find, rest), tail)), self.kind))
            for c, pieces in leaving:
                for p in pieces:
                    del c[p]
        return out


def encoder(path: str, cached: int | None = None) -> Encoder:
    """This worker's encoder; one that keeps another number of pieces is let go first."""
    cached = CACHED if cached is None else cached
    if path not in _ENCODERS or _ENCODERS[path].cached != cached:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, cached)
    hold("tokens", _ENCODERS.clear)
    return _ENCODERS[path]
