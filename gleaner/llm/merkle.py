"""Document fingerprints as Merkle trees, with DataFrame functions only.

Leaves are pieces of a text: up to 64 characters and the sentence ends after them, so that pieces after
an edit are the same again from the next sentence on. Leaves form paragraphs (lines), paragraphs form
sections, which end where a paragraph's own hash says so, and sections form the root. Every node is the
whole SHA-256 of its children's, so roots are equal just when texts are; where they differ, the branches
that differ hold the edits, and edits goes down from the root along these alone.

A fingerprint is written as root:sections:paragraphs:leaves, the beginnings of hashes within a level
split by commas; a semicolon follows the last leaf of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import key, stage
from gleaner.llm.ordering import followed

_PIECE = "[^.!?|\\n]{1,64}[.!?|\\n]*|[.!?|\\n]+"
#: A section ends after a paragraph whose hash begins with 0 or 1. In a fingerprint hashes of inner nodes have
#: INNER digits and those of leaves LEAF.
_SECTION_END, INNER, LEAF = "\\b([01][0-9a-f]+,)", 16, 8


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _short(hashes: Column, digits: int) -> Column:
    """The beginnings of hashes."""
    return F.regexp_replace(hashes, f"([0-9a-f]{{{digits}}})[0-9a-f]{{{64 - digits}}}", "$1")


def _level(parts: Column) -> Column:
    """The hashes of some strings, empty ones left out, each with a comma after it."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(_hash(p), F.lit(","))), "")


def _leaves(text: Column) -> Column:
    """The hashes of a text's pieces, each with a comma after it, or a line feed where a paragraph ends."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(_hash(p), F.when(p.endswith("\n"), F.lit("\n")).otherwise(F.lit(",")))), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the tree of a text column, null as the empty text. Level by level, so that each level is computed once."""
    leaves, paragraphs, sections = f"_{name}_l", f"_{name}_p", f"_{name}_s"
    df = df.withColumn(leaves, _leaves(F.col(text)))
    df = df.withColumn(paragraphs, _level(F.split(F.replace(F.col(leaves), F.lit("\n"), F.lit("\n;")), ";")))
    df = df.withColumn(sections, _level(F.split(F.regexp_replace(F.col(paragraphs), _SECTION_END, "$1;"), ";")))
    short = F.translate(_short(F.col(leaves), LEAF), "\n", ";")
    df = df.withColumn(name, F.concat_ws(":", _hash(F.col(sections)), _short(F.col(sections), INNER), _short(F.col(paragraphs), INNER), short))
    return df.drop(leaves, paragraphs, sections)


def _part(fingerprint_: Column, level: int) -> Column:
    return F.filter(F.split(F.split_part(fingerprint_, F.lit(":"), F.lit(level + 1)), "[,;]"), lambda h: h != "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else the share of different leaves that two trees have in common, below 1."""
    x, y = F.array_distinct(_part(a, 3)), F.array_distinct(_part(b, 3))
    both = F.size(F.array_intersect(x, y))
    dice = F.when(F.size(x) + F.size(y) > 0, 2.0 * both / (F.size(x) + F.size(y))).otherwise(0.0)
    return F.when(F.split_part(a, F.lit(":"), F.lit(1)) == F.split_part(b, F.lit(":"), F.lit(1)), F.lit(1.0)).otherwise(F.least(dice, F.lit(0.999999)))


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def _differing(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """How many leading elements two arrays share, and how many elements of each come between those and the
    trailing ones that they share."""

    def shared(p: Column, q: Column, n: Column) -> Column:
        at = F.array_position(F.zip_with(F.slice(p, F.lit(1), n), F.slice(q, F.lit(1), n), lambda u, v: u != v), True).cast("int")
        return F.when(at > 0, at - 1).otherwise(n)

    n = F.least(F.size(x), F.size(y))
    front = shared(x, y, n)
    back = shared(F.reverse(x), F.reverse(y), n - front)
    return front, F.size(x) - front - back, F.size(y) - front - back


def edits(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with where tree b differs from tree a, from the root down: a struct of section, sections,
    old_sections, paragraph, paragraphs, old_paragraphs, leaf, leaves, old_leaves.

    section is the number, from 0, of the first section that differs, sections how many of b's do and
    old_sections in place of how many of a's; only paragraphs below these are compared, and only leaves
    below paragraphs that differ. Left out, added, moved and replaced pieces lie within that range, and all
    outside of it is equal. Equal trees have only zeros as counts.
    """
    cols = {c: f"_{name}_{c}" for c in ("sa", "sb", "s", "pa", "pb", "p", "p0", "la", "lb", "l", "l0")}
    join = lambda parts, pattern: _filled(F.split(F.array_join(parts, ""), pattern))
    triple = lambda x, y: F.array(*_differing(F.col(cols[x]), F.col(cols[y])))
    cut = lambda parts, at, n: F.slice(parts, at + 1, n)
    for tree, c in ((a, "sa"), (b, "sb")):  # a section is the text of its paragraphs' hashes
        df = df.withColumn(cols[c], _filled(F.split(F.regexp_replace(F.split_part(F.col(tree), F.lit(":"), F.lit(3)), _SECTION_END, "$1;"), ";")))
    df = df.withColumn(cols["s"], triple("sa", "sb"))
    front, old, new = (F.col(cols["s"])[k] for k in range(3))
    df = df.withColumn(cols["p0"], F.size(join(F.slice(cols["sa"], F.lit(1), front), ",")))
    df = df.withColumn(cols["pa"], join(cut(F.col(cols["sa"]), front, old), ",")).withColumn(cols["pb"], join(cut(F.col(cols["sb"]), front, new), ","))
    df = df.withColumn(cols["p"], triple("pa", "pb"))
    start = F.col(cols["p0"]) + F.col(cols["p"])[0]
    for tree, c, n in ((a, "la", 1), (b, "lb", 2)):  # a paragraph is the text of its leaves' hashes
        lines = _filled(F.split(F.split_part(F.col(tree), F.lit(":"), F.lit(4)), "(?<=;)"))
        if c == "la":
            df = df.withColumn(cols["l0"], F.size(join(F.slice(lines, F.lit(1), start), "[,;]")))
        df = df.withColumn(cols[c], join(cut(lines, start, F.col(cols["p"])[n]), "[,;]"))
    df = df.withColumn(cols["l"], triple("la", "lb"))
    s, p, l = (F.col(cols[c]) for c in ("s", "p", "l"))  # noqa: E741
    found = F.struct(
        s[0].alias("section"), s[2].alias("sections"), s[1].alias("old_sections"),
        start.alias("paragraph"), p[2].alias("paragraphs"), p[1].alias("old_paragraphs"),
        (F.col(cols["l0"]) + l[0]).alias("leaf"), l[2].alias("leaves"), l[1].alias("old_leaves"),
    )
    return df.withColumn(name, found).drop(*cols.values())


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Trees of docs (doc_id, text, ...) against an edited text and the next document.

    In the edited text the last half of the code points, rounded down, is replaced by as many first ones
    of the next document by ascending doc_id (the first document after the last). Result: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row. Null
    counts as the empty text. A null doc_id comes first. Different texts with one doc_id follow each
    other by a hash of the text; rows equal in id and text count as one document and get one result
    each. A single document follows itself. Empty in, empty out.
    """
    text = F.coalesce("text", F.lit(""))
    source = docs.select(key(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = followed(source.select("doc", "tie", F.char_length("text").alias("n")).distinct(), ["doc", "tie"], "next")
    order = stage(order.select("doc", "tie", F.floor(F.col("n") / 2).cast("int").alias("half"), F.col("next.doc").alias("n_doc"), F.col("next.tie").alias("n_tie")))
    trees = source.select("doc", "tie", "text")
    after = order.select("n_doc", "n_tie", "half", F.col("doc").alias("p_doc"), F.col("tie").alias("p_tie"))
    heads = trees.join(after, (F.col("doc") == F.col("n_doc")) & (F.col("tie") == F.col("n_tie")))
    heads = with_fingerprint(heads, "text", "next_fingerprint")
    heads = heads.select("p_doc", "p_tie", F.substring("text", F.lit(1), F.col("half")).alias("head"), F.concat_ws(":", F.split_part("next_fingerprint", F.lit(":"), F.lit(1)), F.lit(""), F.lit(""), F.split_part("next_fingerprint", F.lit(":"), F.lit(4))).alias("next_fingerprint")).dropDuplicates(["p_doc", "p_tie"])
    out = trees.join(heads, (F.col("doc") == F.col("p_doc")) & (F.col("tie") == F.col("p_tie")))
    n = F.char_length("text")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "head"))
    out = with_fingerprint(with_fingerprint(out, "text", "fingerprint"), "edited", "edited_fingerprint")
    return out.select(
        F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
