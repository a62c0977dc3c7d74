"""SentencePiece encoding and decoding by a table of distinct marked words.

In the model's normal form every space is the marker U+2581 and one stands before the text. No
piece has a marker after another character (checked when the model is loaded), so no merge
crosses from one marked word (a run of markers and what follows up to the next) to the next. So
each distinct marked word of an Arrow batch is segmented once, by the sentencepiece library;
the table of words carries over to later batches up to a bound. Ids are joined back by position.

Decoding also works on the table: a word's ids give its text.

Defined cases: null text counts as empty and has no ids; rows stay as they are, repeated ones
too; texts of any length are taken whole; an empty table returns no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: A marked word: markers, then anything else up to the next marker. Only the first may lack them.
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words kept from batch to batch.
TABLE = 200_000


class WordTable:
    """Distinct marked words with their ids, as a list, as text, and decoded."""

    def __init__(self, path: str, most: int = TABLE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        self.known: dict[str, tuple[int, str, str]] = {}
        crossing = (i for i in range(self.model.get_piece_size()) if MARK in self.model.id_to_piece(i).lstrip(MARK))
        if next(crossing, None) is not None:
            raise ValueError("pieces cross word markers: words cannot be segmented apart")
        self.mark = self.model.piece_to_id(MARK)

    def learn(self, words: set[str]) -> None:
        """Segments the words that are not in the table, each once."""
        if len(self.known) > self.most:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        # the library sets the first marker itself, and takes a space for any other
        for w, ids in zip(new, self.model.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1), strict=True):
            self.known[w] = (ids, ",".join(map(str, ids)), " " + self.model.decode(ids))
        if MARK in new:  # a last space: the library gives an empty text no marker
            self.known[MARK] = ([self.mark], str(self.mark), " ")

    def split(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def codec(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256, ids (array<int>), decoded."""
    return docs.select("doc_id", "text").mapInArrow(_runner(model_path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As `codec`, without the ids and the text themselves."""
    return docs.select("doc_id", "text").mapInArrow(_runner(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _runner(model_path: str, whole: bool):
    def run(batches):
        table = WordTable(model_path)
        for batch in batches:
            step = max(1, min(1000, batch.num_rows))
            for r0 in range(0, batch.num_rows, step):
                part = batch.slice(r0, step)
                texts = [table.split(t or "") for t in part.column(1).to_pylist()]
                table.learn({w for ws in texts for w in ws})
                known = table.known
                out = []
                for words in texts:
                    rows = [known[w] for w in words]
                    decoded = "".join([r[2] for r in rows])[1:]
                    ids_text = ",".join([r[1] for r in rows])
                    row = (ids_text.count(",") + 1 if rows else 0, hashlib.sha256(ids_text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    out.append((*row, [i for r in rows for i in r[0]], decoded) if whole else row)
                cols = [part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()], strict=False))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return run
