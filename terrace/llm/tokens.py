"""Token ids of whole texts by a public tokenizer, as flat arrays.

The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Words
are split at spaces and line feeds only (other white space stays inside a "word" and is left to the tokenizer),
each distinct word is encoded once, and its ids are kept by the word's 64-bit hash for the next batches, in a
bounded store. The tokenizer lowers letters and parts them from marks anyway; doing so ahead leaves fewer distinct
words. Texts beside one of its special strings, and those for a
tokenizer that does neither, are left as they are.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terrace.llm.words import LOWERED, hashed, split, translated

WORD_BPE = "word_bpe_49k.json"
#: Distinct words whose ids a process keeps; beyond, it starts anew.
KEPT_WORDS = 1_000_000


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer looks for ahead of everything else, in their exact case.
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        marks = self.tokenizer.pre_tokenizer.pre_tokenize_str("a.") if self.tokenizer.pre_tokenizer else []
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("A") == "a" and len(marks) == 2
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes of the words kept, ascending
        self.slot = np.empty(0, np.int64)  # and where each word's length and start stand
        self.ids = np.empty(0, np.uint16)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint16, int(lengths.sum())), lengths

    def _places(self, distinct: pa.Array) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self._forget()
        hashes = hashed(distinct)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            flat, lengths = self._encoded(distinct.filter(pa.array(new)).to_pylist())
            slot = np.concatenate((self.slot, len(self.lengths) + np.arange(len(lengths))))
            known = np.concatenate((self.known, hashes[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], slot[order]
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, flat))
            at = np.searchsorted(self.known, hashes)
        return self.slot[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        lines = translated(texts, LOWERED)
        if not self.folds or any(pc.any(pc.match_substring(lines, word)).as_py() for word in self.special):
            lines = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        else:
            lines = pc.replace_substring_regex(lines, r"([a-z])([.,;:!?])", r"\1 \2")
        codes, counts, distinct = split(lines)
        place = self._places(distinct)[codes]
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - lengths, lengths)
        ids = self.ids[np.repeat(self.starts[place], lengths) + within]
        until = np.concatenate(([0], ends))[np.cumsum(counts)]
        return ids, np.diff(until, prepend=0)


@lru_cache(maxsize=4)
def word_ids(name: str = WORD_BPE) -> WordIds:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
    return WordIds(public_tokenizers.path(name))
