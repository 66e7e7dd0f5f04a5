"""Token ids by the ``tokenizers`` library, each distinct chunk of text encoded once.

Both supported kinds of vocabulary cut a text at white space before any merge: byte-level BPE keeps one leading blank
with the next word, word-end BPE drops white space. A text is cut at the same places, the library encodes each distinct
chunk once, and ids are gathered with numpy. The ids equal those of the library on the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the vocabularies' patterns see it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that always form a piece of their own after a letter.
TAIL = ".,!?;:*#$%&|)\""
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Two white-space characters in a row, one of which a text is cut at; RE2 syntax.
_ODD = f"[{SPACE}][ \n]|[ \n][{SPACE}]|\\x00"
_INNER = re.compile(f"[{SPACE}]")


class _Rows(dict):
    """key of a chunk -> row; new keys get the next row and wait in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, key: str) -> int:
        row = self[key] = len(self)
        self.pending.append(key)
        return row


class Encoder:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text (null as '').

    Where a vocabulary keeps white space, a chunk is a blank or line break with the word behind it; texts with two of
    them in a row, or with U+0000, are cut by a pattern instead. ``limit`` bounds the remembered chunks: beyond it the
    memory is emptied after the step at hand. Keys: the first chunk of a text carries U+0000, a word stands for itself
    with a blank before it, a chunk that begins with a line break for itself.
    """

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.keeps_space = bool(self._ids(" "))
        self.between = "\n" if self.keeps_space else " \x01 "
        self.between_id = self._ids(self.between)
        self.limit = limit
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.rows = _Rows()
        self.ids = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.first = np.empty(1 << 18, np.int64)
        self.count = np.empty(1 << 18, np.int64)

    def _chunk(self, key: str) -> str:
        if not self.keeps_space:
            return key
        if key[:1] == "\0":
            return key[1:]
        return key if key[:1] == "\n" else " " + key

    def _parts(self, key: str) -> tuple[str, str]:
        """A key as two: a line break and the word behind it, or a word that ends in a Latin letter and its marks."""
        if self.keeps_space and key[0] == "\n" and len(key) > 1:
            return "\0\n", "\0" + key[1:]
        core = key.rstrip(TAIL)
        if len(core) == len(key) or not core or core[-1] > "ÿ" or not core[-1].isalpha():
            core, tail = key, ""
        else:
            tail = "\0" + key[len(core):] if self.keeps_space else key[len(core):]
        if not self.keeps_space and core.isascii():
            low = core.lower()
            if low == core or not any(t in low for t in self.special):
                return low, tail
        return core, tail

    def _append(self, ids: np.ndarray) -> int:
        begin = self.used
        while begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[begin : begin + len(ids)] = ids
        self.used += len(ids)
        return begin

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``rows`` in a row, and where each ends."""
        count = self.count[rows]
        ends = np.cumsum(count)
        at = np.repeat(self.first[rows] - (ends - count), count)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _put_plain(self, keys: list[str]) -> None:
        """Ids of chunks by the library: many chunks in one text with a separator of one known id, the odd ones alone."""
        alone, joined = [], []
        for key in keys:
            chunk = self._chunk(key)
            odd = not chunk.strip() or _INNER.search(chunk, 1) or "\x01" in chunk or (chunk[0] != " " and chunk[0].isspace())
            (alone if odd else joined).append((key, chunk))
        for begin in range(0, len(joined), 500):
            part = joined[begin : begin + 500]
            found = np.array(self._ids(self.between.join([chunk for _, chunk in part])), np.uint32)
            cuts = np.flatnonzero(found == self.between_id[0]) if len(self.between_id) == 1 else np.empty(0, np.int64)
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            rows = [self.rows[key] for key, _ in part]
            begins = np.concatenate([[0], cuts + 1])
            self.first[rows] = self._append(found) + begins
            self.count[rows] = np.append(cuts, len(found)) - begins
        for key, chunk in alone:
            ids, row = self._ids(chunk), self.rows[key]
            self.first[row], self.count[row] = self._append(np.array(ids, np.uint32)), len(ids)

    def _put_pairs(self, pairs: list[tuple[int, int, int]]) -> None:
        """Ids of chunks that consist of two known ones; row -1 stands for nothing."""
        if pairs:
            row, core, tail = np.array(pairs, np.int64).T
            both = np.stack([core, tail], axis=1).ravel()
            ids, ends = self._gather(both[both >= 0])
            until = ends[np.cumsum((tail >= 0) + 1) - 1]
            self.count[row] = np.diff(until, prepend=0)
            self.first[row] = self._append(ids) + until - self.count[row]

    def _fill(self) -> None:
        rows, pairs, lines, plain = self.rows, [], [], []
        k = 0
        while k < len(rows.pending):
            key = rows.pending[k]
            core, tail = self._parts(key) if key else ("", "")
            if core == key:
                plain.append(key)
            else:
                (lines if core == "\0\n" else pairs).append((rows[key], rows[core], rows[tail] if tail else -1))
            k += 1
        rows.pending.clear()
        while len(rows) > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self._put_plain(plain)
        self._put_pairs(pairs)
        self._put_pairs(lines)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all chunks of ``texts``, and how many each text has."""
        marked = pc.binary_join_element_wise("\0", texts, "") if self.keeps_space else texts
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n" if self.keeps_space else " "), " ")
        distinct = lists.flatten().dictionary_encode()
        row = np.fromiter(map(self.rows.__getitem__, distinct.dictionary.to_pylist()), np.int64, len(distinct.dictionary))
        return row[distinct.indices.to_numpy()], np.diff(lists.offsets.to_numpy())

    def _chunks(self, text: str) -> list[str]:
        """The library takes special strings out first, so white space before one is cut as at the end of a text."""
        if self.cut_special is None or not self.cut_special.search(text):
            return _CHUNK.findall(text)
        parts = self.cut_special.split(text)
        return [chunk for i, part in enumerate(parts) for chunk in ([part] if i % 2 else _CHUNK.findall(part))]

    def _words_by_pattern(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [[self.rows["\0" + chunk] for chunk in self._chunks(text)] for text in texts]
        return np.array([r for rows in lists for r in rows], np.int64), np.array([len(rows) for rows in lists], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.keeps_space else np.zeros(len(texts), bool)
        if not odd.any():
            rows, words = self._words(texts)
        else:
            plain, plain_words = self._words(texts.filter(pa.array(~odd)))
            other, other_words = self._words_by_pattern(texts.filter(pa.array(odd)).to_pylist())
            words = np.empty(len(texts), np.int64)
            words[~odd], words[odd] = plain_words, other_words
            rows = np.empty(words.sum(), np.int64)
            of_odd = np.repeat(odd, words)
            rows[~of_odd], rows[of_odd] = plain, other
        self._fill()
        ids, ends = self._gather(rows)
        until = np.concatenate([[0], ends])[np.cumsum(words)]
        if len(self.rows) > self.limit:
            self._clear()
        return ids, np.diff(until, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its memory lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
