"""Fill-in-middle transformation: a text is cut in three at token boundaries and its middle is moved to the end.

Tokens are the isolated matches of a pattern by the tokenizers library's Split pre-tokenizer, which needs no vocabulary and no training and says the
code-point offsets of each.  The array of the tokens' ends is all that is needed: its length is the number of tokens, and the ends of two ranks are the cuts.
Which documents are cut, where and in which order is decided by a hash of their id, so reruns agree and no row depends on another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a word with the white space before it, or white space at the text's end.
TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters of a text that the pre-tokenizer gets at a time, from one end of a word to another: it holds some 30 bytes for each.
STRIDE = 1 << 12
_WORD_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(TOKENS), "isolated")


def token_ends(text: str, splitter=None) -> np.ndarray:
    """Code-point offset of each token's end."""
    splitter, ends, start = splitter or _splitter(), [], 0
    while start < len(text):
        cut = _WORD_END.search(text, start + STRIDE) if len(text) - start > STRIDE else None
        stop = cut.start() if cut else len(text)
        ends += [start + offsets[1] for _, offsets in splitter.pre_tokenize_str(text[start:stop])]
        start = stop
    return np.array(ends, dtype=np.int64)


def _hashes(id_column: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id``, as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text, from output and form alone (a text that is cut holds no mark, so its output has three)."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    at = lambda *places: F.concat(*(F.get(parts, i) for i in places))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def with_fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, cut_percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """``docs`` plus ``n long`` (tokens), ``form string`` (plain, psm, spm), ``prefix_chars long``, ``middle_chars long`` (code points; null if plain) and ``output string``.

    psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle; spm: suffix first, then prefix, then middle, each after its mark.  A text stays plain (its own output) if it is
    null (taken as '') or empty, holds a mark, or its third hash modulo 100 is ``cut_percent`` or more; of the others ``spm_percent`` are spm.
    Whole texts of any length; a null id hashes like an empty one.  Rows are independent: repeated rows repeat their result and an empty table gives an empty one.  Columns named like a
    result are replaced, other names do not matter.  ``restored`` gives the exact text back.
    """
    result = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"

    @F.arrow_udf(result)
    def transform(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        splitter = _splitter()
        prefix_mark, suffix_mark, middle_mark = marks
        for texts, *hashes in batches:
            rows = []
            for i, (h1, h2, h3, h4) in enumerate(zip(*(h.to_pylist() for h in hashes))):
                text = texts[i].as_py() or ""
                ends = token_ends(text, splitter)
                n = len(ends)
                if not text or h3 % 100 >= cut_percent or any(m in text for m in marks):
                    rows.append((n, "plain", None, None, text))
                    continue
                first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:first], text[first:last], text[last:]
                if h4 % 100 < spm_percent:
                    rows.append((n, "spm", first, last - first, f"{suffix_mark}{suffix}{prefix_mark}{prefix}{middle_mark}{middle}"))
                else:
                    rows.append((n, "psm", first, last - first, f"{prefix_mark}{prefix}{suffix_mark}{suffix}{middle_mark}{middle}"))
            columns = list(zip(*rows)) if rows else [()] * len(RESULTS)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(RESULTS))

    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in RESULTS]
    made = transform(docs[f"`{text_column}`"], *_hashes(docs[f"`{id_column}`"], seed)).alias("_fill_in_middle")
    # results and inputs are told apart by a struct, whatever the inputs' names
    return docs.select(F.struct(*kept).alias("_row"), made).select("_row.*", *(F.col(f"_fill_in_middle.{c}") for c in RESULTS))
