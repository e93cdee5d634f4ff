"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of labelled documents. Texts are
lower-cased and reduced to their words' letters, then cut into pieces; each piece is
compressed against every dictionary, and the language with the smallest sum wins. Where the
runner-up needs hardly more bytes the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapops.llm.common import thinned

#: Labelled documents taken for each language, those with the smallest hash of their id.
SAMPLE = 400
#: Bytes of a dictionary, and of a piece.
DICTIONARY = 128 << 10
PIECE = 8192
LEVEL = 5
#: Up to so many bytes a text is encoded at a level that also uses matches of three bytes.
SHORT, SHORT_LEVEL = 256, 12
#: The runner-up must need at least this share more, or the text is rejected.
MARGIN = 0.002
UNKNOWN = "und"
#: ASCII other than lower-case letters becomes a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def reduced(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def dictionaries(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw content for each language from ``doc_id, text, lang``; rows with a null or no letter teach nothing.

    At most ``sample`` documents a language are drawn, documents of up to 8 KB first, and of
    each no more than 8 KB, which bounds what the driver receives. The most frequent language
    comes first.
    """
    taught = labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = taught.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id", (F.octet_length("text") > 8192).alias("long"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    few = thinned(rows, ["lang", "long"], ["doc_id", "text"], sample).withColumn("text", F.substring("text", 1, 8192))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", "text"), "doc_id", "text")
    drawn = few.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample)
    found: dict[str, list] = {}
    for lang, n, text in drawn.select("lang", "__n", "text").collect():
        found.setdefault(lang, []).append((n, text))
    return {lang: reduced("\n".join(t for _, t in sorted(texts, reverse=True)))[-DICTIONARY:] for lang, texts in sorted(found.items(), key=lambda item: (-counts[item[0]], item[0]))}


def identified(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row.

    ``score`` is how much smaller the best encoding is than the runner-up, as a share of the
    latter, over ten times that share plus one tenth: 0 for a tie, near 1 for a clear case.
    Defined cases: null texts and those without a letter are ``und`` with score 0 and are
    rejected; ties go to the language that comes first in ``content`` and are rejected; with one known language
    the score is 1; with none every text is ``und``; long texts are read whole, piece by piece.
    """
    names = list(content)
    blobs = [content[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, short = [], []
        for blob in blobs:
            known = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
            fine = zstandard.ZstdCompressionParameters.from_level(SHORT_LEVEL, source_size=SHORT, dict_size=len(blob), min_match=3, write_content_size=False)
            whole = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            short.append(zstandard.ZstdCompressor(dict_data=whole, compression_params=fine))
        for batch in batches:
            langs, scores, rejects = [], [], []
            for text, letters in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
                if not letters or not coders:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejects.append(True)
                    continue
                view = memoryview(b" " + reduced(text.as_py()) + b" ")
                sizes = [0] * len(coders)
                for at in range(0, len(view), PIECE):
                    piece = view[at : at + PIECE]
                    for k, coder in enumerate(coders if len(view) > SHORT else short):
                        sizes[k] += len(coder.compress(piece))
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for k, s in enumerate(sizes) if k != best), default=None)
                lead = 1.0 if second is None else (second - sizes[best]) / second
                langs.append(names[best])
                scores.append(1.0 if second is None else lead / (lead + 0.1))
                rejects.append(lead < margin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
