"""Fill-in-the-middle transformation by splitting texts at zero-width boundaries.

A unit grammar says which characters may stand before and behind a boundary.  It
is translated to a regular expression of one lookbehind and one lookahead, which
match no character, so that Spark's split keeps every character in a piece.  Two
hashes of the id choose the cuts among the boundaries, two more the form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from isobath.llm.common import quoted, with_fields

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Grammar:
    """The class of the character before a boundary and of the one behind it, as regular expressions of one character."""

    before: str
    behind: str

    def boundary(self) -> str:
        """A regular expression that matches the empty string at every boundary, never at the ends of a text."""
        return f"(?s)(?<={self.before})(?={self.behind})"


#: Units: single code points; words with the white space behind them; lines with their end; sentences with the white space behind them.
GRAMMARS = {
    "char": Grammar(".", "."),
    "word": Grammar(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),
    "line": Grammar(r"\n", "."),
    "sentence": Grammar(r"[.!?][\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The pieces of text; they join to it again.  An empty text has none (split alone would give one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def _draws(id_text: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _join(pieces: Column, first: Column, n: Column) -> Column:
    """n pieces from the one at first (from 0) as one text."""
    return F.array_join(F.slice(pieces, first + 1, n), "")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ADDED = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "char", rate: int = 90, spm_rate: int = 20, seed: int = 1) -> DataFrame:
    """docs with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The text is cut into n units of the grammar ``unit``.  The prefix ends at the
    smaller of two random boundaries, the middle at the larger one, both ends of
    the text included; the suffix is the rest.  A document is left ``plain`` if
    its text is empty, holds one of the marks already, or for (100 - rate) of 100
    ids; otherwise spm_rate of 100 are written suffix first (``spm``), the others
    prefix first (``psm``).  restore() gives the text back from output and form.

    The draws depend on the id and the seed only, so repeated rows agree; a null
    id counts as an empty one.  A null text is an empty text.  Lengths are in code
    points, null for plain documents.  Texts are taken whole; a text needs about
    100 times its size of memory while it is cut.  Columns with the added names
    are replaced, an empty table gives an empty one.
    """
    whole = F.coalesce(quoted(text), F.lit(""))
    h1, h2, h3, h4 = _draws(F.coalesce(quoted(id_col).cast("string"), F.lit("")), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | whole.contains(mark)
    form = F.when((whole == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")

    def build(pieces: Column) -> Column:
        n = F.size(pieces).cast("long")
        a, b = h1 % (n + 1), h2 % (n + 1)
        low, high = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        return F.struct(n.alias("n"), _join(pieces, F.lit(0), low).alias("p"), _join(pieces, low, high - low).alias("m"), _join(pieces, high, n.cast("int") - high).alias("s"))

    # bound to a variable, so that a text is split once
    cut = F.transform(F.array(units(whole, GRAMMARS[unit])), build)[0]

    def write(both: Column) -> Column:
        c, f = both["cut"], both["form"]
        psm = F.concat(F.lit(PREFIX), c["p"], F.lit(SUFFIX), c["s"], F.lit(MIDDLE), c["m"])
        spm = F.concat(F.lit(SUFFIX), c["s"], F.lit(PREFIX), c["p"], F.lit(MIDDLE), c["m"])
        moved = f != "plain"
        return F.struct(
            c["n"].alias("n"), f.alias("form"), F.when(moved, F.length(c["p"]).cast("long")).alias("prefix_chars"), F.when(moved, F.length(c["m"]).cast("long")).alias("middle_chars"),
            F.when(f == "plain", whole).when(f == "psm", psm).otherwise(spm).alias("output"),
        )

    made = F.transform(F.array(F.struct(cut.alias("cut"), form.alias("form"))), write)
    rest = [quoted(c) for c in with_fields(docs, ADDED)[0].columns]
    # inline() evaluates what it is given once a row
    return docs.select(*rest, F.inline(made))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
