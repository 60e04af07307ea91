"""Token counts by section from one encoding of the whole document.

A document is its fields, joined by a separator that belongs to the field before it; the last field
falls into sections at its line ends, each line end belonging to the line it ends. The joined text is
encoded once, so counts are those a model would see, and each token's character span is joined to the
section spans. Byte-level tokens tile the text's bytes; a map from bytes to characters turns their places
into spans of characters, and a token that holds only part of a character has that character as its span.

A token that crosses a boundary is allocated by an explicit rule:
``majority`` gives it to the section with most of its characters, the earlier on a tie; ``first`` to the
section of its first character. Either way the sections' counts add up to the document's tokens. Beside the
counts, ``token_share`` splits every crossing token by characters.

Cases, all defined: a null field is empty; an empty field or section has zero tokens and keeps its row,
so a document with nothing in it has one row for each field. Repeated rows are encoded each and give
repeated rows. An empty table gives an empty result. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_slices

MAJORITY, FIRST = "majority", "first"
SECTIONS = (
    "doc_id long, section long, field string, char_start long, char_end long, n_tokens long, n_crossing long, "
    "token_share double, doc_tokens long"
)


@cache
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file, and the bytes of each token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def char_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts and ends, in characters, from the text's UTF-8 bytes and the tokens' lengths in bytes."""
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(begins)])
    ends = np.cumsum(lengths)
    return upto[ends - lengths + 1] - 1, upto[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and token shares of each section, from token spans and section ends in characters."""
    n = len(section_ends)
    head = np.searchsorted(section_ends, starts, side="right")
    tail = np.searchsorted(section_ends, ends - 1, side="right")
    inside = head == tail
    counts = np.bincount(head[inside], minlength=n)
    shares = counts.astype(float)
    crossing = np.zeros(n, np.int64)
    for i in np.flatnonzero(~inside):
        touched = np.arange(head[i], tail[i] + 1)
        upto = np.minimum(section_ends[touched], ends[i])
        held = np.diff(np.concatenate([[starts[i]], upto]))
        counts[touched[0] if rule == FIRST else touched[held.argmax()]] += 1
        crossing[touched[held > 0]] += 1
        shares[touched] += held / (ends[i] - starts[i])
    return counts, crossing, shares


def sections_of(values: Sequence[str], fields: Sequence[str], separator: str) -> tuple[list[str], list[str]]:
    """The pieces that make up the joined text, and the field of each."""
    lines = values[-1].split("\n")
    pieces = [v + separator for v in values[:-1]] + [line + "\n" for line in lines[:-1]] + lines[-1:]
    return pieces, list(fields[:-1]) + [fields[-1]] * len(lines)


def attribute(
    docs: DataFrame, path: str | Callable[[], str], pattern: str, fields: Sequence[str] = ("text",), separator: str = " ",
    rule: str = MAJORITY, id_col: str = "doc_id",
) -> DataFrame:
    """One row for each section of each document: its place, its tokens by ``rule``, and its token share.

    ``path`` is the vocabulary file's, or a function that finds it on the machine of each task.
    """
    if rule not in (MAJORITY, FIRST):
        raise ValueError(f"rule is {rule!r}")
    names = [part.split()[0] for part in SECTIONS.split(", ")]

    def make() -> Callable[..., dict]:
        encoding, token_bytes = encoder(path() if callable(path) else path, pattern)

        def work(ids: list, *columns: list) -> dict:
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, *values in zip(ids, *columns, strict=True):
                pieces, of = sections_of([v or "" for v in values], fields, separator)
                whole = "".join(pieces)
                tokens = encoding.encode_ordinary(whole)
                section_ends = np.cumsum([len(p) for p in pieces])
                starts, ends = char_spans(whole.encode(), token_bytes[np.array(tokens, np.int64)])
                counts, crossing, shares = allocate(starts, ends, section_ends, rule)
                chars = section_ends.tolist()
                n = len(pieces)
                rows = ([doc_id] * n, range(n), of, [0, *chars[:-1]], chars, counts, crossing, shares, [len(tokens)] * n)
                for name, values_of in zip(names, rows, strict=True):
                    out[name].extend(values_of)
            return out

        return work

    rows = docs.select(F.col(id_col).cast("long"), *(F.col(f).cast("string") for f in fields))
    return map_slices(rows, make, SECTIONS)
