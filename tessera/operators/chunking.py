"""Chunkers: fixed, by section, semantic, hierarchical, and the choice between them.

Packing runs over the document's own array of sentence lengths, inside the JVM; documents never meet, so
that chunking needs no shuffle. Input: doc_id, text. Chunks: doc_id, chunk_index, text,
token_count, and what the chunker adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.arrays import greedy, let, runs
from ..functions.checks import chunk_id
from ..functions.tokens import chunk_tokens, word_count

SMALL, LARGE = 1000, 500_000


def _pack(parts: Column, size: int) -> Column:
    """Greedy packing of strings: an array of joined strings, none over size tokens unless a part is."""
    units = lambda p: F.transform(p, lambda x: F.struct(chunk_tokens(x).alias("n"), F.lit(0).alias("key")))
    return let(parts, lambda p: let(greedy(units(p), size), lambda starts: F.transform(runs(p, starts), lambda r: F.array_join(r, " "))))


def packed_sentences(text: Column, size: int) -> Column:
    """Sentences packed to size; a longer sentence is a run of its own, packed from its comma-separated parts."""
    return packed_array(tx.sentences(text), size)


def packed_array(sentences: Column, size: int) -> Column:
    """As packed_sentences, of an array of sentences."""

    def units(sentence: Column, i: Column) -> Column:
        def parts(n: Column) -> Column:
            cut = F.filter(F.transform(F.split(sentence, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
            short = F.array(F.struct(sentence.alias("p"), n.alias("n"), F.lit(-1).alias("key")))
            long = F.transform(cut, lambda p: F.struct(p.alias("p"), chunk_tokens(p).alias("n"), i.alias("key")))
            return F.when(n > size, long).otherwise(short)

        return let(chunk_tokens(sentence), parts)

    flat = F.flatten(F.transform(sentences, units))
    return let(flat, lambda u: let(greedy(u, size), lambda starts: F.transform(runs(u, starts), lambda r: F.array_join(F.transform(r, lambda x: x["p"]), " "))))


def clean_chunk(text: Column) -> Column:
    """Without page and block marks, white space squeezed."""
    bare = F.when(text.contains("["), F.regexp_replace(text, r"\[PAGE \d+\]|\[HEADER\]|\[FOOTER\]|\[TABLE \d+\]", "")).otherwise(text)
    return F.trim(F.regexp_replace(bare, r" \s+|[^\S ]\s*", " "))  # lone blanks, most of all, are left as they are


def _measured(text: Column) -> Column:
    """(text, token_count) of a chunk as it is given out."""
    return let(clean_chunk(text), lambda t: F.struct(t.alias("text"), chunk_tokens(t).alias("token_count")))


def _exploded(docs: DataFrame, chunks: Column, keep: list[str] = ()) -> DataFrame:
    """A row per chunk. Chunks are cleaned and measured within the array: as columns of their rows they would be so again
    in each filter that is pushed below them."""
    rows = docs.select("doc_id", *keep, F.posexplode(F.transform(chunks, _measured)).alias("chunk_index", "__c"))
    return rows.select("doc_id", *keep, "chunk_index", "__c.text", "__c.token_count")


def fixed(docs: DataFrame, size: int = 512, min_tokens: int = 100, overlap: int = 0) -> DataFrame:
    """Fixed-size chunks; those under min_tokens go, and indexes keep their gaps. overlap: tokens lent by the neighbours."""
    made = _exploded(docs, packed_sentences(F.col("text"), size)).where(F.col("token_count") >= min_tokens)
    made = with_overlap(made, overlap) if overlap else made
    return made.withColumn("chunk_id", chunk_id("doc_id", "chunk_index"))


def with_overlap(chunks: DataFrame, tokens: int) -> DataFrame:
    """Each chunk with the end of the one before and the start of the one after, about `tokens` each."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")

    def head(t: str, n: str) -> Column:
        cut = F.substring(F.col(t), F.lit(1), (F.length(t) * tokens / F.greatest(F.lit(1), F.col(n))).cast("int"))
        return F.when(F.col(n) <= tokens, F.col(t)).otherwise(F.regexp_replace(cut, r"\s+\S*$", ""))

    def tail(t: str, n: str) -> Column:
        length = F.greatest(F.lit(1), (F.length(t) * tokens / F.greatest(F.lit(1), F.col(n))).cast("int"))
        return F.when(F.col(n) <= tokens, F.col(t)).otherwise(F.substring(F.col(t), -length, length))

    near = chunks.withColumns({"__pt": F.lag("text").over(by), "__pn": F.lag("token_count").over(by), "__nt": F.lead("text").over(by), "__nn": F.lead("token_count").over(by)})
    joined = near.withColumn("text", F.concat_ws(" ", tail("__pt", "__pn"), F.col("text"), head("__nt", "__nn")))
    return joined.drop("__pt", "__pn", "__nt", "__nn").withColumn("token_count", chunk_tokens("text"))


def _shares(chunks: DataFrame, *keep: Column) -> DataFrame:
    """Each chunk with the words it has (a), those of the next one (b), and the share of common ones (of the smaller set, in %).

    Texts are what is shuffled; their words take several times the room."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    pairs = chunks.repartition("doc_id").select("doc_id", "chunk_index", *keep, words.alias("a")).withColumn("b", F.lead("a").over(by))
    return pairs.withColumn("share", F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")) * 100)


def _share_figures() -> list[Column]:
    return [F.count("share").alias("pairs"), F.round(F.avg("share"), 4).alias("mean_share"), F.round(F.min("share"), 4).alias("least_share"), F.round(F.max("share"), 4).alias("most_share")]


def _size_figures(chars: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 4).alias("mean_tokens"),
        F.min("token_count").alias("least_tokens"), F.max("token_count").alias("most_tokens"), F.sum(chars).alias("chars"),
    ]


def overlap_statistics(chunks: DataFrame) -> DataFrame:
    """Per document: pairs of neighbours, and the mean, least and largest share of common words (of the smaller set, in %)."""
    return _shares(chunks).where("b IS NOT NULL").groupBy("doc_id").agg(*_share_figures())


def suffix_prefix(a: Column, b: Column) -> Column:
    """The most words that end a and begin b."""

    def longest(wa: Column, wb: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(wa), F.size(wb))))
        # Where the first word does not agree, nothing is sliced.
        begun = F.filter(lengths, lambda k: F.get(wa, F.size(wa) - k) == wb[0])
        return F.coalesce(F.array_max(F.filter(begun, lambda k: F.slice(wb, 1, k) == F.slice(wa, F.size(wa) - k + 1, k))), F.lit(0))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.split(a, r"\s+"), lambda wa: let(F.split(b, r"\s+"), lambda wb: longest(wa, wb))))


def without_overlap(chunks: DataFrame) -> DataFrame:
    """Chunks without the words at their start that end the chunk before."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    n = F.coalesce(suffix_prefix(F.lag("text").over(by), F.col("text")), F.lit(0))
    rest = chunks.withColumn("__n", n)
    words = F.split("text", r"\s+")
    return rest.withColumn("text", F.array_join(F.slice(words, F.col("__n") + 1, F.size(words)), " ")).drop("__n").withColumn("token_count", chunk_tokens("text"))


def merged(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Neighbouring chunks merged while they stay within max_tokens."""
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("x"))
    return _exploded(listed.withColumn("parts", F.transform("x", lambda x: x["text"])), _pack(F.col("parts"), max_tokens))


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(*_size_figures(F.length("text")))


def all_statistics(chunks: DataFrame) -> DataFrame:
    """statistics() and, null for documents of one chunk, overlap_statistics(), in one pass."""
    made = _shares(chunks, F.col("token_count"), F.length("text").alias("chars"))
    found = made.groupBy("doc_id").agg(*_size_figures(F.col("chars")), *_share_figures(), F.count("b").alias("__b"))
    return found.withColumn("pairs", F.when(F.col("__b") > 0, F.col("pairs"))).drop("__b")


# Line classes of the section chunker; fixed values.
SECTION, NUMBERED, SUBSECTION, ITEM = r"^[a-z]\)\s+[A-Z]", r"^\d+\.\s+[A-Z\s&]+:", r"^●.*:", "❖"


def header_kind(line: Column) -> Column:
    bare = F.trim(line)
    capital = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (F.length(bare) > 15)
    return F.when(bare.rlike(SECTION), "section").when(bare.rlike(SUBSECTION), "subsection").when(bare.rlike(NUMBERED), "section").when(capital & ~bare.startswith("●"), "category")


def section_headers(docs: DataFrame) -> DataFrame:
    """doc_id, line, kind, title of every header line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", header_kind(F.col("t")).alias("kind"), F.trim("t").alias("title")).where("kind IS NOT NULL")


def by_section(docs: DataFrame, size: int = 512, min_tokens: int = 100) -> DataFrame:
    """A chunk per section of the text; large sections are packed from their items or sentences.

    Categories are no breaks. Lines before the first header belong to a section without a title."""
    breaks = lambda x: F.coalesce(header_kind(x).isin("section", "subsection"), F.lit(False))
    headers = lambda l: F.filter(F.transform(l, lambda x, i: F.when(breaks(x), i)), lambda i: i.isNotNull())
    starts = lambda l: F.array_distinct(F.concat(F.array(F.lit(0)), headers(l)))
    cut = docs.select("doc_id", F.posexplode(let(F.split("text", "\n"), lambda l: let(starts(l), lambda s: runs(l, s)))).alias("section", "lines"))
    body = cut.select("doc_id", "section", F.when(breaks(F.col("lines")[0]), F.trim(F.col("lines")[0])).alias("title"), F.array_join("lines", "\n").alias("body"))
    items = F.filter(F.split("body", f"(?={ITEM})"), lambda p: F.trim(p) != "")
    parts = F.when(chunk_tokens("body") <= size * 1.5, F.array("body")).when(F.col("body").contains(ITEM), _pack(items, size)).otherwise(packed_sentences(F.col("body"), size))
    rows = body.select("doc_id", "section", "title", F.posexplode(F.transform(parts, _measured)).alias("part", "__c"))
    rows = rows.select("doc_id", "section", "title", "part", "__c.text", "__c.token_count").where(F.col("token_count") >= min_tokens)
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "part")) - 1)


def breakpoints(vectors: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Segments of sentence vectors (doc_id, pos, embedding): a break where the similarity with the next is
    below the (1 - threshold) quantile of the document's similarities. Adds similarity and segment."""
    from ..functions.vectors import cosine

    by = Window.partitionBy("doc_id").orderBy("pos")
    near = vectors.withColumn("similarity", cosine(F.col("embedding"), F.lead("embedding").over(by)))
    limit = near.withColumn("limit", F.percentile("similarity", F.lit(1 - threshold)).over(Window.partitionBy("doc_id")))
    broken = limit.withColumn("breaks", F.coalesce(F.col("similarity") < F.col("limit"), F.lit(False)).cast("int"))
    segment = F.coalesce(F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return broken.withColumn("segment", segment.cast("int")).drop("limit", "breaks")


def semantic(docs: DataFrame, embed=None, size: int = 512, threshold: float = 0.80, min_tokens: int = 100, vectors: DataFrame | None = None) -> DataFrame:
    """Chunks of neighbouring sentences alike in meaning, by embed, a column function of a text, or by given vectors (doc_id, pos,
    embedding) of the sentences, counted from 0.

    Documents that have a sentence without a vector, or all where there is neither embed nor vectors, are chunked by size
    (fell_back), with the indexes that they have there."""
    sentences = docs.select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "s"))
    if vectors is not None:
        sentences = sentences.join(vectors.select("doc_id", "pos", "embedding"), ["doc_id", "pos"], "left")
    else:
        sentences = sentences.withColumn("embedding", embed(F.col("s")) if embed else F.lit(None).cast("array<float>"))
    cut = breakpoints(sentences, threshold).withColumn("fell_back", F.max(F.col("embedding").isNull()).over(Window.partitionBy("doc_id")))
    cut = cut.withColumn("segment", F.when(F.col("fell_back"), 0).otherwise(F.col("segment")))
    segments = cut.groupBy("doc_id", "segment", "fell_back").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("x"))
    parts = F.transform("x", lambda x: x["s"])
    of_size = lambda p: let(F.array_join(p, " "), lambda w: F.when(chunk_tokens(w) > size * 1.5, _pack(p, size)).otherwise(F.array(w)))
    packed = let(parts, lambda p: F.when(F.col("fell_back"), packed_array(p, size)).otherwise(of_size(p)))
    rows = segments.select("doc_id", "segment", "fell_back", F.posexplode(F.transform(packed, _measured)).alias("part", "__c"))
    rows = rows.select("doc_id", "segment", "fell_back", "part", "__c.text", "__c.token_count").where(F.col("token_count") >= min_tokens)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "part")) - 1
    return rows.withColumn("chunk_index", F.when(F.col("fell_back"), F.col("part")).otherwise(index))


def _children(docs: DataFrame, parent: int, child: int, bodies: bool = False) -> DataFrame:
    """Children of all parents in a row, so that their places in it are their numbers; bodies: with their parent's text."""

    def below(p: Column, i: Column) -> Column:
        made = lambda body: F.transform(packed_sentences(p, child), lambda c: F.struct(i.alias("parent_index"), _measured(c).alias("c"), *body))
        return let(clean_chunk(p), lambda body: made([body.alias("parent_text")])) if bodies else made([])

    flat = let(packed_sentences(F.col("text"), parent), lambda ps: F.flatten(F.transform(ps, below)))
    rows = docs.select("doc_id", F.posexplode(flat).alias("chunk_index", "__c"))
    return rows.select("doc_id", F.lit("child").alias("kind"), "__c.parent_index", "chunk_index", "__c.c.text", "__c.c.token_count", *(["__c.parent_text"] if bodies else []))


def hierarchical(docs: DataFrame, parent: int = 2048, child: int = 512, min_tokens: int = 100) -> DataFrame:
    """Parents and, below each, its children; children are numbered through the document and name their parent."""
    parents = docs.select("doc_id", F.posexplode(F.transform(packed_sentences(F.col("text"), parent), _measured)).alias("parent_index", "__c"))
    tops = parents.select("doc_id", F.lit("parent").alias("kind"), "parent_index", F.lit(None).cast("int").alias("chunk_index"), "__c.text", "__c.token_count")
    return tops.union(_children(docs, parent, child).where(F.col("token_count") >= min_tokens))


def with_parents(docs: DataFrame, parent: int = 2048, child: int = 512, min_tokens: int = 100) -> DataFrame:
    """The children of hierarchical() with their parent's text, as expand_to_parent() of them, without a second pass or a join."""
    return _children(docs, parent, child, True).where(F.col("token_count") >= min_tokens)


def expand_to_parent(chunks: DataFrame) -> DataFrame:
    """Children with their parent's text; children without one keep their own."""
    tops = chunks.where("kind = 'parent'").select(F.col("doc_id").alias("d"), F.col("parent_index").alias("p"), F.col("text").alias("parent_text"))
    kids = chunks.where("kind = 'child'")
    return kids.join(tops, (F.col("doc_id") == F.col("d")) & (F.col("parent_index") == F.col("p")), "left").drop("d", "p").withColumn("parent_text", F.coalesce("parent_text", "text"))


def structure_signs() -> tuple[dict[str, Column], Column]:
    """Five signs of structure in a text, by name, and how many of them it shows."""
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n")
    signs = {
        "project_headers": F.regexp_count(t, F.lit(r"(?m)^[a-z]\)\s+[A-Z]")) > 2,
        "bullets": F.regexp_count(t, F.lit("[●❖]")) > 5,
        "numbered": F.regexp_count(t, F.lit(r"(?m)^\d+\.\s+[A-Z]")) > 2,
        "subsections": F.regexp_count(t, F.lit(r"(?m)^●\s+\w+.*:")) > 3,
        "indented": F.size(F.filter(lines, lambda x: x.startswith("   ") | x.startswith("\t"))) > F.size(lines) * 0.2,
    }
    return signs, sum((c.cast("int") for c in signs.values()), F.lit(0))


def structure(docs: DataFrame) -> DataFrame:
    """Five signs of structure; two make a structured document."""
    signs, score = structure_signs()
    return docs.select("doc_id", *[c.alias(n) for n, c in signs.items()], (score / 5).alias("structure_score"), (score >= 2).alias("has_structure"))


def strategy(docs: DataFrame, small: int = SMALL, large: int = LARGE, size: int = 512, child: int = 512) -> DataFrame:
    """The chunker that a document's size calls for, with the measures behind the choice and whether it is structured.

    Structured documents of a middle size go to the chunker of sections, which is a part of the semantic one."""
    n, t, signs = chunk_tokens("text"), F.coalesce("text", F.lit("")), structure_signs()[1]
    measured = docs.select(
        "doc_id", n.alias("tokens"), F.length(t).alias("chars"), word_count("text").alias("words"), F.size(tx.sentences("text")).alias("sentences"),
        F.size(F.filter(F.split(t, "\n\n"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != "")).alias("paragraphs"),
        signs.alias("signs"),
    ).withColumns({"structure_score": F.col("signs") / 5, "has_structure": F.col("signs") >= 2}).drop("signs")
    picked = F.when(F.col("tokens") <= small, "fixed").when(F.col("tokens") <= large, "semantic").otherwise("hierarchical")
    estimate = lambda per: F.greatest(F.lit(1), F.floor(F.col("tokens") / per).cast("int"))
    return measured.withColumns({
        "strategy": picked, "category": F.when(F.col("tokens") <= small, "small").when(F.col("tokens") <= large, "medium").otherwise("large"),
        "estimated_chunks": estimate(size), "estimated_semantic": estimate(2 * size), "estimated_hierarchical": estimate(child),
        "mean_sentence": F.when(F.col("sentences") > 0, F.round(F.col("words") / F.col("sentences"), 4)).otherwise(0.0),
    })


# What speaks for each chunker; fixed values.
ADVICE = {"fixed": "Small documents, homogeneous content", "semantic": "Medium documents, structured content", "hierarchical": "Large documents, complex structure"}


def recommendations(docs: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """Per document and chunker: whom it suits, the chunks to expect, and whether it is the chosen one."""
    chosen = strategy(docs, small, large)
    estimate = {"fixed": "estimated_chunks", "semantic": "estimated_semantic", "hierarchical": "estimated_hierarchical"}
    rows = F.array(*[F.struct(F.lit(k).alias("chunker"), F.lit(v).alias("recommended_for"), F.col(estimate[k]).alias("chunks")) for k, v in ADVICE.items()])
    return chosen.select("doc_id", F.explode(rows).alias("x"), "strategy", "has_structure").select("doc_id", "x.*", (F.col("strategy") == F.col("x.chunker")).alias("selected"), "has_structure")


def clearly_structured(kind: Column, sections: Column, paragraphs: Column, pages: Column) -> Column:
    """A word file of several sections or over 50 paragraphs, or a PDF of over ten pages."""
    docx = (kind == "docx") & ((F.coalesce(sections, F.lit(0)) > 1) | (F.coalesce(paragraphs, F.lit(0)) > 50))
    return docx | ((kind == "pdf") & (F.coalesce(pages, F.lit(0)) > 10))


def adaptive(docs: DataFrame, embed=None, small: int = SMALL, large: int = LARGE, size: int = 512, min_tokens: int = 100, vectors: DataFrame | None = None) -> DataFrame:
    """Each document by the chunker of its size; of the middle ones, those with section headers by section, the others
    as semantic() does with embed or vectors."""
    headed = F.exists(F.split("text", "\n"), lambda x: header_kind(x).isNotNull())
    middle = F.when(headed, "section").otherwise("semantic")
    chosen = let(chunk_tokens("text"), lambda n: F.when(n <= small, "fixed").when(n > large, "hierarchical").otherwise(middle))
    cols = ["doc_id", "chunk_index", "text", "token_count", "strategy"]
    by = {
        "fixed": lambda d: fixed(d, size, min_tokens),
        "section": lambda d: by_section(d, size, min_tokens),
        "semantic": lambda d: semantic(d, embed, size, min_tokens=min_tokens, vectors=vectors),
        "hierarchical": lambda d: hierarchical(d, child=size, min_tokens=min_tokens).where("kind = 'child'"),
    }
    made = None
    for name, chunk in by.items():
        part = chunk(docs.where(chosen == name)).withColumn("strategy", F.lit(name)).select(cols)
        made = part if made is None else made.unionByName(part)
    return made


def without_boundaries(docs: DataFrame, size: int = 512) -> DataFrame:
    """Chunks of size estimated tokens whatever stands there: cut after so many words as make them."""
    every = max(1, int(size / 1.33))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = lambda w: F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(w) - 1, F.lit(every)))
    return _exploded(docs, let(words, lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i + 1, every), " "))))


def validated(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, whether their indexes have no gap, blank ones, and ones without tokens."""
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count(F.lit(1)) - 1) & (F.countDistinct("chunk_index") == F.count(F.lit(1)))).alias("contiguous"),
        F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("token_count") == 0).alias("without_tokens"),
    )


def page_numbers(chunks: DataFrame) -> DataFrame:
    """chunks (with marks still in text) with page_number: of the first [PAGE n] within, else of the last one before."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    marks = F.regexp_extract_all("text", F.lit(r"\[PAGE (\d+)\]"), F.lit(1))
    first, last = F.get(marks, F.lit(0)), F.get(marks, F.size(marks) - 1)
    return chunks.withColumn("page_number", F.coalesce(first, F.last(last, True).over(by)).cast("int"))


def family(chunks: DataFrame) -> DataFrame:
    """Per parent of hierarchical chunks: its children's indexes, in order."""
    kids = chunks.where("kind = 'child'").groupBy("doc_id", "parent_index").agg(F.sort_array(F.collect_list("chunk_index")).alias("children"))
    return kids.withColumn("n_children", F.size("children"))


def without_following(chunks: DataFrame) -> DataFrame:
    """Chunks without the words at their end that begin the chunk after."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    rest = chunks.withColumn("__n", F.coalesce(suffix_prefix(F.col("text"), F.lead("text").over(by)), F.lit(0)))
    words = F.split("text", r"\s+")
    return rest.withColumn("text", F.array_join(F.slice(words, F.lit(1), F.size(words) - F.col("__n")), " ")).drop("__n").withColumn("token_count", chunk_tokens("text"))


def without_either(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, the text of without_overlap() (without_front) and that of without_following() (without_back): what a
    chunk shares with the one before is what that one shares with it, and is measured once."""
    by, words = Window.partitionBy("doc_id").orderBy("chunk_index"), F.split("text", r"\s+")
    shared = chunks.withColumn("__front", F.coalesce(suffix_prefix(F.lag("text").over(by), F.col("text")), F.lit(0)))
    shared = shared.withColumns({"__back": F.coalesce(F.lead("__front").over(by), F.lit(0)), "__w": words})
    front = F.array_join(F.slice("__w", F.col("__front") + 1, F.size("__w")), " ")
    return shared.select("doc_id", "chunk_index", front.alias("without_front"), F.array_join(F.slice("__w", F.lit(1), F.size("__w") - F.col("__back")), " ").alias("without_back"))


def overlap_adjusted(chunks: DataFrame, target: int, tolerance: int = 10) -> DataFrame:
    """Chunks whose overlap with the next is near target tokens: the next one's start is lent, or one's own end cut.

    The overlap is measured in words that end the one and begin the other, of the unchanged chunks."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    near = chunks.withColumn("__next", F.lead("text").over(by)).withColumn("__words", F.split("text", r"\s+"))  # words behind the shuffle
    shared = suffix_prefix(F.col("text"), F.col("__next"))
    near = near.withColumn("__shared", shared).withColumn("__have", chunk_tokens(F.array_join(F.slice("__words", F.greatest(F.lit(1), F.size("__words") - F.col("__shared") + 1), F.col("__shared")), " ")))
    per_word = lambda tokens: F.floor(tokens / F.lit(1.33)).cast("int")
    following = F.split("__next", r"\s+")
    lent = F.array_join(F.slice(following, F.col("__shared") + 1, per_word(F.lit(target) - F.col("__have"))), " ")
    cut = F.array_join(F.slice("__words", F.lit(1), F.greatest(F.lit(1), F.size("__words") - per_word(F.col("__have") - target))), " ")
    text = F.when(F.col("__next").isNull() | (F.abs(F.col("__have") - target) <= tolerance), F.col("text")).when(F.col("__have") < target, F.concat_ws(" ", "text", lent)).otherwise(cut)
    return near.withColumn("text", text).drop("__next", "__words", "__shared", "__have").withColumn("token_count", chunk_tokens("text"))


def overlap_sentences(sentences: Column, tokens: int) -> Column:
    """The last sentences of an array that fit in so many tokens together."""
    sizes = F.transform(F.reverse(sentences), lambda s: chunk_tokens(s))
    taken = F.aggregate(
        sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open")),
        lambda a, x: F.struct(F.when(a["open"] & (a["n"] + x <= tokens), a["n"] + x).otherwise(a["n"]).alias("n"), F.when(a["open"] & (a["n"] + x <= tokens), a["k"] + 1).otherwise(a["k"]).alias("k"), (a["open"] & (a["n"] + x <= tokens)).alias("open")),
        lambda a: a["k"],
    )
    return F.slice(sentences, F.size(sentences) - taken + 1, taken)
