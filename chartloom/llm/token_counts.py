"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

A text is cut into pieces at boundaries over which the tokenizer never looks, so that a text's count is the sum of its pieces' counts however long it is.
Only tokenizers whose files prove such boundaries are cut for; texts of any other go to the library whole.  The pieces that a worker has not met lately are
encoded in batches of about ``BATCH_BYTES``, whatever number of texts they come from, and of each only the number of tokens is kept.

Boundaries:

* byte-level BPE with its own pattern, no normaliser, no prefix space and added tokens without white space: between a character that is not white space and one
  that is.  No alternative of the pattern goes over such a place, and its only look-ahead (white space at the end of a run) stays in the run.
* SentencePiece BPE models with the identity normaliser and a dummy prefix, in which no piece has a space mark after another character: before a space; the piece
  behind it loses that space, as the library puts one in front of each text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.pieces import SPACE, PieceModel

#: Bytes of text that go to the library at a time; pieces that a worker remembers, and the longest of them; characters of a text that are cut into pieces at a time.
BATCH_BYTES, REMEMBERED, REMEMBERED_CHARS, STRIDE = 1 << 18, 500_000, 64, 1 << 20
#: Unicode's White_Space.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class LengthCounter:
    """Counts the tokens of texts with one tokenizer file: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, data: bytes, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}  # known before that, so that frequent pieces outlive a change
        self._dropped = ""
        self._piece: re.Pattern | None = None
        if kind == ".json":
            self._encode = self._json(data)
        elif kind == ".model":
            self._encode = self._model(data)
        else:
            raise ValueError(f"{kind}: neither .json nor .model")

    def _json(self, data: bytes) -> Callable[[list[str]], list[int]]:
        from tokenizers import Tokenizer

        text = data.decode("utf-8")
        said = json.loads(text)
        coder = Tokenizer.from_str(text)
        coder.no_truncation()
        coder.no_padding()
        before, kind = said.get("pre_tokenizer") or {}, said["model"].get("type")
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not said.get("normalizer")
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(f"[{WHITE}]", t["content"]) for t in said.get("added_tokens") or [])
        if plain and added and kind == "BPE" and not said["model"].get("dropout"):
            self._piece = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
            self._next = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
        return lambda texts: [len(e) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, data: bytes) -> Callable[[list[str]], list[int]]:
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_proto=data)
        try:
            model = PieceModel(data)
        except ValueError:  # another normaliser or kind of model: its texts stay whole
            model = None
        if model and model.cuttable and model.prefixed:
            self._dropped = f" {SPACE}"
            # a run of spaces at the text's end belongs to the word before it
            self._piece = re.compile(f"[ {SPACE}]*[^ {SPACE}]+(?:[ {SPACE}]+\\Z)?|[ {SPACE}]+")
            self._next = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]+(?=[^ {SPACE}])")
        return lambda texts: [len(ids) for ids in coder.encode(texts, num_threads=1, add_bos=False, add_eos=False)]

    def _strides(self, text: str) -> Iterator[list[str]]:
        """Pieces of the text, so many characters' worth at a time."""
        start = 0
        while start < len(text):
            cut = self._next.search(text, start + STRIDE) if self._piece and len(text) - start > STRIDE else None
            stop = cut.start() if cut else len(text)
            part = text[start:stop]
            found = self._piece.findall(part) if self._piece else [part]
            if self._dropped:
                found = [p[1:] if (i or start) and p[0] in self._dropped else p for i, p in enumerate(found)]
            yield found
            start = stop

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null has none."""
        totals = [0] * len(texts)
        waiting: dict[str, list[int]] = {}  # a piece and the texts that have it, as often as they have it
        known, older, size = self._known, self._older, 0
        for i, text in enumerate(texts):
            for pieces in self._strides(text or ""):
                for piece in pieces:
                    if (n := known.get(piece)) is not None:
                        totals[i] += n
                    elif (n := older.get(piece)) is not None:
                        totals[i] += n
                        known[piece] = n
                    elif (at := waiting.get(piece)) is not None:
                        at.append(i)
                    else:
                        waiting[piece] = [i]
                        size += len(piece.encode("utf-8"))
                        if size >= BATCH_BYTES:
                            self._settle(waiting, totals)
                            waiting, size = {}, 0
        self._settle(waiting, totals)
        if len(known) > REMEMBERED:
            self._known, self._older = {}, known
        return totals

    def _settle(self, waiting: dict[str, list[int]], totals: list[int]) -> None:
        for (piece, at), n in zip(waiting.items(), self._encode(list(waiting)) if waiting else []):
            for i in at:
                totals[i] += n
            if self._piece and len(piece) <= REMEMBERED_CHARS:
                self._known[piece] = n


_COUNTERS: dict[tuple[int, str], tuple[bytes, LengthCounter]] = {}


def _counter(data: bytes, kind: str) -> LengthCounter:
    key = (hash(data), kind)
    if key not in _COUNTERS:
        _COUNTERS[key] = (data, LengthCounter(data, kind))
    return _COUNTERS[key][1]


def with_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text_column: str = "text") -> DataFrame:
    """``docs`` plus ``n_bytes long`` (UTF-8), ``n_tokens long`` and ``over_limit boolean`` (more than ``limit`` tokens).

    Counts are those of the library for the file (``tokenizers`` for .json, ``sentencepiece`` for .model), without begin, end or added special tokens, truncation or
    padding; strings of special tokens inside a text are handled as the library does by default.  Whole texts of any length; a null or empty text has 0 bytes and
    tokens.  Rows are independent: repeated rows repeat their counts and an empty table gives an empty one.  Columns named like a result are replaced, other
    names do not matter.  The file is read on the driver and its bytes travel with the task; only texts go to Python, and only numbers come back.
    """
    with open(tokenizer_path, "rb") as file:
        data = file.read()
    kind = os.path.splitext(tokenizer_path)[1]

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(data, kind)
        for batch in batches:
            yield pa.array(np.fromiter((n for i in range(0, len(batch), 256) for n in counter.count(batch.slice(i, 256).to_pylist())), dtype=np.int64, count=len(batch)))

    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    text = docs[f"`{text_column}`"]
    counted = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), lengths(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
