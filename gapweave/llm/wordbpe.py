"""Token ids of texts by a public word-level BPE file, each distinct word once.

The file's normalizer and splitter never join characters across white space, so a
text's ids are those of its words in a row; most words repeat, so encoding distinct
words is several times faster than encoding texts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from . import textops

VOCABULARY, END = "word_bpe_49k.json", 2
#: A line with a word: letters of Latin-1 or below, then ASCII punctuation without the apostrophe and the marks that special tokens hold; or any other word.
_LINE = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)|(.+))$", re.M)
#: Entries that a worker keeps between batches.
_MOST = 300_000
_cache: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes Arrow columns; keeps the ids of word cores and marks seen so far (bounded)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        # Each piece that the splitter makes ends with such a token.
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for t, k in vocab.items() if t.endswith("</w>")]] = True

    def _runs(self, pieces: list[str]) -> list[bytes]:
        """Ids (32 bits each) of pieces that the splitter leaves whole, encoded as texts of many pieces."""
        out = []
        for k in range(0, len(pieces), 10_000):
            part = pieces[k : k + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            raw, ends = ids.tobytes(), ends.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, whole: list[str], others: list[str]) -> dict[str, bytes]:
        """All pieces that are known now, with new ones."""
        fresh = dict(zip(whole, self._runs(whole))) if whole else {}
        fresh |= {p: array("I", e.ids).tobytes() for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))}
        if len(self.known) + len(fresh) > _MOST:
            both, self.known = self.known | fresh, {"": b""}
            return both
        self.known.update(fresh)
        return self.known

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        parts = _LINE.findall("\n".join(words)) if words else []
        cores, marks = [c.lower() if c else other for c, _, other in parts], [m for _, m, _ in parts]
        known = self.known
        other = {o for _, _, o in parts if o not in known}
        if whole := [p for p in {*cores, *marks} if p not in known and p not in other]:
            known = self._learn(whole, [*other])
        elif other:
            known = self._learn([], [*other])
        return [known[a] + known[b] if b else known[a] for a, b in zip(cores, marks)]

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with an end id, and where each text starts (one more entry ends the last)."""
        flat, ends = textops.split(texts)
        d = flat.dictionary_encode()
        made = [*self.words(d.dictionary.to_pylist()), np.uint32(end).tobytes()]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(np.frombuffer(b"".join(made), np.uint32)))
        # The end of a text is one more word.
        code = np.full(len(flat) + len(ends) - 1, len(made) - 1, np.int32)
        is_word = np.ones(len(code), bool)
        is_word[ends[1:] + np.arange(len(ends) - 1)] = False
        code[is_word] = d.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[code])])
        return table.take(pa.array(code)).flatten().to_numpy(), upto[ends + np.arange(len(ends))]


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]
