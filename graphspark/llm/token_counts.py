"""Token counts: pieces are counted once per distinct pre-token, joined to each
document's pre-token frequencies and summed; no id list of a document is made.

The distinct pre-tokens, their piece counts and the join are kept per block of
documents (with a bounded table that a worker carries from block to block). A
join over the whole corpus would shuffle every (document, pre-token) pair, over
twice the input, for the same sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, held, id_text, table

#: Pre-tokens that a worker's table of piece counts holds at most.
TABLE_ENTRIES = 500_000
#: Longer pre-tokens are counted and not kept.
KEPT_CHARS = 64
#: Beyond these letters the library's own pre-tokeniser splits the text, as the
#: character classes of two Unicode versions may differ there.
FAR = re.compile("[^\u0000-ȳ]")


class PieceCounter:
    """Token counts of whole texts for one byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pieces: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        if FAR.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Special strings in the text, and the frequencies of its pre-tokens."""
        if self.specials is None or not self.specials.search(text):
            return 0, Counter(self.pretokens(text))
        parts, found = self.specials.split(text), Counter()
        for part in parts:
            found.update(self.pretokens(part))
        return len(parts) - 1, found

    def count(self, texts: list[str]) -> list[int]:
        """Joins the block's frequencies with its distinct pre-tokens' counts."""
        if len(self.pieces) > TABLE_ENTRIES:
            self.pieces.clear()
        per_text = [self.frequencies(x) for x in texts]
        distinct: set[str] = set()
        for _, found in per_text:
            distinct.update(found)
        pieces, own = self.pieces, {}
        fresh = [x for x in distinct if x not in pieces]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for word, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                own[word] = len(made)
        pieces.update(x for x in own.items() if len(x[0]) <= KEPT_CHARS)
        out = []
        for extra, found in per_text:
            out.append(extra + sum([n * (pieces[w] if w in pieces else own[w]) for w, n in found.items()]))
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty text: no bytes, no tokens. Repeated rows are counted each.
    An empty table gives an empty result; other columns are ignored.
    ``tokenizer``: path of a byte-level BPE file, present on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"counts {tokenizer}", lambda: PieceCounter(tokenizer))
        for part, raw in blocks(batches):
            made = counter.count([x.decode() for x in raw])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(made, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
