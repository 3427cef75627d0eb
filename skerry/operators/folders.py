"""The folder graph of file paths, search over it, and notes of folders with their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.tables import cut, small

NAME_WEIGHT, FILE_WEIGHT, HOP_DECAY, NOTE_DECAY = 2.0, 1.0, 0.5, 0.4


def ancestors(paths: DataFrame) -> DataFrame:
    """``folder, path``: every file with each folder above it, the root being ''."""
    parts = F.split("path", "/")
    n = F.size(parts)
    return paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))


def folders(paths: DataFrame) -> DataFrame:
    """``folder, parent, n_files, n_subfolders``, with ancestors that hold no file."""
    every = ancestors(paths).select("folder").unionByName(paths.sparkSession.createDataFrame([("",)], "folder string")).distinct()
    own = paths.select("path").distinct().groupBy(T.parent_of(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"))
    subs = every.filter("folder <> ''").groupBy(T.parent_of(F.col("folder")).alias("folder")).agg(F.count("*").alias("n_subfolders"))
    out = every.join(own, "folder", "left").join(subs, "folder", "left")
    return out.select("folder", T.parent_of(F.col("folder")).alias("parent"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_subfolders")))


def contents(paths: DataFrame) -> DataFrame:
    """``folder, kind, item``: the names of the files and subfolders a folder holds itself, as rows, so that a folder of
    any size is no single value."""
    every = ancestors(paths).select("folder").distinct().filter("folder <> ''")
    subs = every.select(T.parent_of(F.col("folder")).alias("folder"), F.lit("subfolder").alias("kind"), F.col("folder").alias("item"))
    return subs.unionByName(paths.select("path").distinct().select(T.parent_of(F.col("path")).alias("folder"), F.lit("file").alias("kind"), F.col("path").alias("item")))


def tokens(paths: DataFrame) -> DataFrame:
    """``folder, kind, token``: distinct words of a folder's own name and of the names of its files."""
    every = ancestors(paths).select("folder").distinct().filter("folder <> ''")
    names = every.select("folder", F.lit("name").alias("kind"), F.explode(T.name_tokens(T.stem_name(F.col("folder")))).alias("token"))
    files = paths.select("path").distinct().select(T.parent_of(F.col("path")).alias("folder"), F.lit("file").alias("kind"), F.explode(T.name_tokens(T.stem_name(F.col("path")))).alias("token"))
    return names.unionByName(files).distinct()


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.name_tokens(F.coalesce("query", F.lit(""))))).alias("token"))


def scores(paths: DataFrame, queries: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """``query_id, folder, score`` above 0: 2 for a word of the name, 1 for a word of a file name. ``named``: the result of
    ``tokens``, if it is at hand."""
    hit = (tokens(paths) if named is None else named).join(small(query_tokens(queries)), "token")
    return hit.groupBy("query_id", "folder").agg(F.sum(F.when(F.col("kind") == "name", NAME_WEIGHT).otherwise(FILE_WEIGHT)).alias("score"))


def neighbours(paths: DataFrame) -> DataFrame:
    """``folder, n_neighbours``: parent, subfolders and siblings, counted without pairing siblings."""
    f = folders(paths)
    kids = f.select(F.col("folder").alias("parent"), F.col("n_subfolders").alias("kids"))
    return f.join(kids, "parent", "left").select("folder", (F.when(F.col("parent").isNull(), 0).otherwise(F.col("kids")) + F.col("n_subfolders")).alias("n_neighbours"))


def expand(f: DataFrame, seeds: DataFrame, hops: int, decay: float = HOP_DECAY) -> DataFrame:
    """``query_id, folder, score``: the best of own score and decayed scores of neighbours, over ``hops`` hops.

    A folder gets from its parent, its subfolders and its siblings, each by the best score among them,
    so siblings meet in a maximum of their parent and are never paired.
    """
    up = f.select("folder", "parent")
    ranked = seeds.select("query_id", "folder", F.col("score").cast("double").alias("score"))
    for _ in range(max(0, hops)):
        best = ranked.join(up.filter("parent IS NOT NULL"), "folder").groupBy("query_id", F.col("parent")).agg(F.max("score").alias("score"))
        to_parent = best.select("query_id", F.col("parent").alias("folder"), "score")
        # What a folder passes to its subfolders: its own score, or the best of its subfolders (their siblings).
        passed = ranked.unionByName(to_parent).groupBy("query_id", "folder").agg(F.max("score").alias("score"))
        down = passed.withColumnRenamed("folder", "parent").join(up, "parent").select("query_id", "folder", "score")
        got = to_parent.unionByName(down).select("query_id", "folder", (F.col("score") * decay).alias("score"))
        ranked = cut(ranked.unionByName(got).groupBy("query_id", "folder").agg(F.max("score").alias("score")))
    return ranked


def best_folders(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "folder")
    return scored.withColumn("folder_rank", F.row_number().over(w)).filter(F.col("folder_rank") <= n)


def search(paths: DataFrame, queries: DataFrame, k: int = 10, hops: int = 1, max_folders: int = 5, tree: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, path, passage_id, score, snippet``: files of the folders that fit a query best. ``tree`` and
    ``named``: the results of ``folders`` and ``tokens``, if they are at hand.

    A folder gives its best ``2 k`` files only: of these at most ``k - 1`` can stand in better folders, so no other
    can be among the ``k``. They are picked within tasks before anything is shuffled.
    """
    paths = paths.select("path").distinct()
    seeds = best_folders(scores(paths, queries, named), max(1, max_folders)).select("query_id", "folder", "score")
    ranked = best_folders(expand(folders(paths) if tree is None else tree, seeds, hops), max(1, max_folders))
    qt = query_tokens(queries).groupBy("query_id").agg(F.collect_set("token").alias("qt"))  # the words of one query
    hit = ancestors(paths).join(small(cut(ranked.join(qt, "query_id"))), "folder")
    overlap = F.size(F.array_intersect(F.array_distinct(T.name_tokens(T.basename(F.col("path")))), F.col("qt")))
    hit = hit.select("query_id", "folder_rank", "score", "path", F.struct((-overlap).alias("o"), T.depth_first_key(F.col("path")).alias("key")).alias("order"))
    w = Window.partitionBy("query_id", "folder_rank").orderBy("order")
    hit = hit.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * max(1, k))
    first = hit.groupBy("query_id", "path").agg(F.min(F.struct("folder_rank", "order", "score")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.folder_rank", "m.order")
    out = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    folder = T.parent_of(F.col("path"))
    note = F.concat(F.lit('co-located in folder "'), F.when(folder == "", "/").otherwise(folder), F.lit('" (metadata graph match)'))
    return out.select("query_id", "rank", "path", F.concat("path", F.lit("#0")).alias("passage_id"), F.col("m.score").alias("score"), note.alias("snippet"))


def notes(paths: DataFrame) -> DataFrame:
    """``note, section, item, line`` of a note for each folder: its head, parent, subfolders and files. Lines are
    rows, in the order of section and item, so a folder of any size is no single value."""
    f = folders(paths)
    label = F.when(F.col("folder") == "", "_root").otherwise(F.col("folder"))
    safe = lambda c: F.translate(c, "[]", "()")
    link = lambda c: F.concat(F.lit("- [["), safe(F.when(c == "", "_root").otherwise(c)), F.lit("]]"))
    head = f.select(F.concat(label, F.lit(".md")).alias("note"), F.posexplode(F.array(
        F.lit("---"), F.lit("type: folder"), F.concat(F.lit('path: "'), "folder", F.lit('"')), F.concat(F.lit("files: "), F.col("n_files").cast("string")), F.concat(F.lit("subfolders: "), F.col("n_subfolders").cast("string")),
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.when(F.col("folder") == "", "/ (indexed root)").otherwise(F.col("folder"))), F.lit(""))).alias("i", "line"))
    head = head.select("note", F.lit(0).alias("section"), F.lpad(F.col("i").cast("string"), 2, "0").alias("item"), "line")
    has = f.filter("parent IS NOT NULL")
    md = lambda c: F.concat(F.when(c == "", "_root").otherwise(c), F.lit(".md"))
    up = has.select(md(F.col("folder")).alias("note"), F.lit(1).alias("section"), F.col("parent").alias("item"), link(F.col("parent")).alias("line"))
    down = has.select(md(F.col("parent")).alias("note"), F.lit(2).alias("section"), F.col("folder").alias("item"), link(F.col("folder")).alias("line"))
    own = paths.select("path").distinct().select(md(T.parent_of(F.col("path"))).alias("note"), F.lit(3).alias("section"), T.basename(F.col("path")).alias("item"), F.concat(F.lit("- "), safe(T.basename(F.col("path")))).alias("line"))
    return head.unionByName(up).unionByName(down).unionByName(own)


def links(lines: DataFrame, notes_: DataFrame | None = None) -> DataFrame:
    """``src, dst``: links ``[[name]]`` in lines of notes, both ways; what follows ``|`` (another wording) or ``#`` (a heading)
    isn't part of the name. With ``notes_`` (``path``) a name that is no path of a note stands for the note of that name in
    whatever folder, of several for the first by path; a link to no note leads nowhere."""
    raw = lines.select("note", F.explode(F.regexp_extract_all("line", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("to"))
    name = F.trim(F.regexp_extract("to", r"^([^|#]*)", 1))
    out = raw.select(F.col("note").alias("src"), F.when(F.lower(name).endswith(".md"), name).otherwise(F.concat(name, F.lit(".md"))).alias("dst"), (name == "").alias("own")).filter("NOT own").select("src", "dst").distinct()
    if notes_ is not None:
        every = notes_.select("path").distinct()
        names = every.groupBy(T.basename(F.col("path")).alias("name")).agg(F.min("path").alias("by_name"))
        out = out.join(every, F.col("dst") == F.col("path"), "left").join(names, F.col("dst") == F.col("name"), "left")
        out = out.select("src", F.coalesce("path", "by_name").alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def listed(text: DataFrame, col: str = "text") -> DataFrame:
    """``path``: the notes a listing of a note program names: JSON (an array, or one name) or lines; only Markdown; a
    listing that begins with an error or with ``no`` is empty."""
    t = F.trim(F.regexp_replace(col, r"^\s+|\s+$", ""))
    good = text.select(t.alias("t")).filter("t <> '' AND NOT lower(t) LIKE 'error:%' AND NOT lower(t) LIKE 'no %'")
    one = F.when(F.col("t").rlike(r'^"(?:[^"\\]|\\.)*"$'), F.from_json(F.concat(F.lit("["), "t", F.lit("]")), "array<string>"))
    items = F.coalesce(F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")), one, F.split("t", r"\r?\n"))
    return good.select(F.explode(items).alias("path")).select(F.trim("path").alias("path")).filter("path <> '' AND lower(path) LIKE '%.md'")


def expand_links(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = NOTE_DECAY) -> DataFrame:
    """``query_id, node, score`` over undirected edges, by rounds of join and maximum; ends with the hops."""
    ranked = seeds.select("query_id", "node", F.col("score").cast("double").alias("score"))
    for _ in range(max(0, hops)):
        got = ranked.join(edges, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (F.col("score") * decay).alias("score"))
        ranked = cut(ranked.unionByName(got).groupBy("query_id", "node").agg(F.max("score").alias("score")))
    return ranked


def note_seeds(notes_: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, node, score``: the notes (``path, text``) that hold most words of a query, by reciprocal rank."""
    n = notes_.select("path", "text").dropDuplicates(["path"])
    body = T.without_front_matter(F.coalesce("text", F.lit("")))
    qt = queries.select("query_id", F.explode(F.array_distinct(T.words(F.coalesce("query", F.lit(""))))).alias("w"))
    words = n.select("path", F.explode(T.words(F.concat_ws(" ", T.spaced(F.col("path")), body))).alias("w"))
    hits = words.join(small(qt), "w").groupBy("query_id", "path").agg(F.count_distinct("w").alias("words"), F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("words"), F.desc("n"), "path")
    return hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(1, limit)).select("query_id", F.col("path").alias("node"), (F.lit(1.0) / F.col("r")).alias("score"))


def kb_search(notes_: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, hops: int = 1, limit: int = 10) -> DataFrame:
    """``query_id, rank, path, score, snippet``: scores of the seeds spread over links; the snippet is the part
    of a note about the first word of the query that it holds, or the name of a note without text."""
    ranked = expand_links(edges, note_seeds(notes_, queries, limit), hops)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "node")
    best = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    n = notes_.select("path", T.without_front_matter(F.coalesce("text", F.lit(""))).alias("body")).dropDuplicates(["path"])
    out = best.join(n, F.col("node") == F.col("path"), "left").join(queries, "query_id")
    snip = F.coalesce(F.nullif(T.match_snippet(F.coalesce("body", F.lit("")), F.coalesce("query", F.lit(""))), F.lit("")), T.stem_name(F.col("node")))
    return out.select("query_id", "rank", F.col("node").alias("path"), F.round("score", 6).alias("score"), snip.alias("snippet"))
