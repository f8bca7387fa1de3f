"""Cutting texts at places where byte-level pre-tokenizers always cut.

The pattern starts a piece at every blank before a word and on either side of a line feed between
words. A text whose white space is only that can be cut there by plain string operations, and its
ids are those of the parts in a row. Workers remember the ids of frequent parts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than blanks and line feeds, and the mark that cuts texts.
_OTHER_SPACE = re.compile("[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def plainly_spaced(text: str) -> bool:
    """Whether all white space is single blanks or line feeds between other characters."""
    runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return not (runs or text[:1].isspace() or text[-1:].isspace() or _OTHER_SPACE.search(text))


def parts_array(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The parts of plainly spaced texts in a row, and how many each text has. Blanks stand at the start of parts."""
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    opens = (raw == ord(" ")) | (raw == ord("\n"))
    opens[1:] |= raw[:-1] == ord("\n")
    opens[(ends - size)[size > 0]] = True
    starts = np.flatnonzero(opens)
    cuts = np.concatenate([starts, [len(raw)]]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
    return parts.dictionary_encode(), np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))


def taken(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups that lie in a row (their sizes are given) those that are asked for, in a row, and their sizes."""
    start, count = np.cumsum(size) - size, size[code]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[code] - ends + count, count) + np.arange(total)], count


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the next `count` values, for each count."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return upto[ends] - upto[ends - count]


class Memory:
    """What a worker remembers by key, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def recall(self, keys: list) -> list:
        """The value of each key, None where it is not known; what is asked for stays young."""
        found = list(map(self.young.get, keys))
        for k in [k for k, value in enumerate(found) if value is None] if self.old else ():
            if (value := self.old.get(keys[k])) is not None:
                found[k] = self.young[keys[k]] = value
        return found

    def keep(self, values: dict) -> None:
        self.young.update(values)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
