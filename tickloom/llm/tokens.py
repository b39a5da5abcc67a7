"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string that ends a word is put through the tokenizer's own normaliser,
pre-tokenizer and merges; those that come out as one pre-token and one token are *whole*. The proof is shipped to
the tasks (its size is bound by the vocabulary). A task cuts a text at white space, takes the pre-tokens of each
distinct chunk, counts the whole ones directly and runs the merges for the rest only.

White space never lies inside a pre-token, and neither normalisation nor merging reaches across it, so the chunks
of a text (runs without ASCII white space) add up to the text. Added tokens of the file (``<|endoftext|>``) are
recognised inside texts first, as the library does by default.

Null and empty texts have no bytes and no tokens; repeated rows are counted each; a null doc_id is kept. Texts may
be of any length: they are cut, never shortened. Counts of chunks are kept for the next text of the same
worker, up to ``MEMO`` short ones; beyond that the memory starts anew, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.common import text_batches, utf8

LIMIT = 2048
#: Chunks whose counts a worker remembers, and the longest one (bytes) that it does.
MEMO, MEMO_BYTES = 300_000, 64
_WORD_END = "</w>"
#: Two counts in one number: all tokens, and from this place on those counted directly.
_DIRECT = 1 << 40


@lru_cache(maxsize=2)
def _loaded(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def pre_tokens(tok: Tokenizer, text: str) -> list[str]:
    """The strings the merges start from, in the alphabet of the vocabulary."""
    if tok.normalizer:
        text = tok.normalizer.normalize_str(text)
    return [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(text)] if text else []


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to be one token when they stand alone."""
    tok, alphabet = _loaded(path), byte_alphabet()
    proven = set()
    for entry in tok.get_vocab(with_added_tokens=False):
        piece = entry.removesuffix(_WORD_END)
        if piece == entry or not set(piece) <= alphabet.keys():
            continue
        try:
            text = bytes(alphabet[c] for c in piece).decode()
        except UnicodeDecodeError:
            continue  # a part of a character is never a pre-token
        if pre_tokens(tok, text) == [piece] and [t.value for t in tok.model.tokenize(piece)] == [entry]:
            proven.add(piece)
    return frozenset(proven)


def added_tokens(path: str) -> list[bytes]:
    """Strings that are one token wherever they stand in a text."""
    added = _loaded(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("added tokens that take white space along or follow normalisation are not supported")
    return sorted((t.content.encode() for t in added), key=len, reverse=True)


def counter(path: str, whole: frozenset[str]) -> Callable[[bytes | None], tuple[int, int]]:
    """A function from a text's UTF-8 bytes to its tokens and to those of them that were counted directly."""
    tok = _loaded(path)
    merges = tok.model.tokenize
    added = added_tokens(path)
    marks = re.compile(b"|".join(map(re.escape, added))) if added else None

    def count(chunk: bytes) -> int:
        total = 0
        for piece in pre_tokens(tok, chunk.decode()):
            total += 1 + _DIRECT if piece in whole else len(merges(piece))
        return total

    class Memo(dict):
        def __missing__(self, chunk: bytes) -> int:
            n = count(chunk)
            if len(chunk) <= MEMO_BYTES:
                if len(self) >= MEMO:
                    self.clear()
                self[chunk] = n
            return n

    known = Memo().__getitem__

    def tokens(text: bytes | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        parts = marks.split(text) if marks else [text]
        total = sum(sum(map(known, part.split())) for part in parts)
        return total % _DIRECT + len(parts) - 1, total // _DIRECT

    return tokens


_RESULT = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_direct", pa.int64()), ("over_limit", pa.bool_())])
_DDL = "struct<n_bytes:bigint,n_tokens:bigint,n_direct:bigint,over_limit:boolean>"


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, n_direct (tokens that needed no merge) and
    over_limit (more than ``limit`` tokens). ``path`` names the tokenizer's file, which every executor must have."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    ready: list = []  # this worker's counter

    @F.arrow_udf(_DDL)
    def counted(text: pa.Array) -> pa.Array:
        if not ready:
            ready.append(counter(path, whole.value))
        rows = []
        for t in utf8(text):
            n, direct = ready[0](t)
            rows.append({"n_bytes": len(t or b""), "n_tokens": n, "n_direct": direct, "over_limit": n > limit})
        return pa.array(rows, type=_RESULT)

    return text_batches(docs).select("doc_id", counted("text").alias("_n")).select("doc_id", "_n.*")
