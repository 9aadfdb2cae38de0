"""Operator 4: secret scans, with a random forest that removes false positives.  DataFrame expressions only.

Every run of 20 or more token characters in a text is a candidate, and so is a value of six or more signs of any kind
that is assigned to a name with a secret word in it (``db_password = hunter2#x``); shorter values are not looked at.  A candidate's features are its length, its
character classes and the transitions between them, how likely its character pairs are in ordinary words, how much
of it a dictionary covers, marks of a path, and the words and signs beside it.  A forest is trained on labelled
findings; its trees become nested CASE expressions over the array of candidates, so that scanning is one map over
the rows: no shuffle, no explode, and one text is the largest thing that a task holds.

Dictionary and character pairs are counted over all words of all texts.  The labelled findings are made, by rule, around
words of a bounded sample (a slice of each of the ``sample_rows`` distinct texts of smallest hash): generated keys and passwords in
assignments against digests of commits, checksums, paths, addresses, glued words, plain words, code, rules of signs and placeholders.

Defined cases: null and empty texts have no candidates; candidates are scanned wherever they stand, any number in a text, and
of any length, in time that is linear in it; equal texts and repeated rows get equal findings; an empty table trains no forest and
has no findings; ``redacted`` keeps all columns, but for names of its own with a leading underscore (_found, _pieces, _scores, _features).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.llm.common import kept

#: Words that stand beside secrets, and beside other long tokens.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|auth|credential|bearer|client.?key"
OTHER_WORDS = "commit|sha[0-9]*|md5|checksum|digest|hash|integrity|etag|uuid|guid|revision|blob|version|build|href|src|path|file"
#: A value behind an assignment to a name with a secret word, told by what stands just before it, or a long run of token characters.
ASSIGNED = f"(?<=[=:\"'`]|[=:] )(?<=(?i:{SECRET_WORDS.replace('.?', '[_-]?')})[A-Za-z_]{{0,12}}[\"'`]?\\s{{0,2}}(?::=|=>|=|:) ?[\"'`]?)[^\\s\"'`]{{6,}}"
CANDIDATE = ASSIGNED + r"|[A-Za-z0-9_+/=.\-]{20,}"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = 17
#: Characters of a sampled text that are looked at, at a place drawn by hash.
SLICE = 4000
BAR = 0.5
MARK = "[SECRET]"


@dataclass
class Forest:
    """``pairs``: a number for each pair of LETTERS (or other signs), higher where the pair is likelier; ``words``: the dictionary."""

    trees: list
    pairs: list[int]
    words: list[str]


def _share(part: Column, whole: Column) -> Column:
    return F.length(part) / F.greatest(F.length(whole), F.lit(1))


def _only(c: Column, kept: str) -> Column:
    return F.regexp_replace(c, f"[^{kept}]", "")


def _likely_pairs(low: Column, pairs: list[int]) -> Column:
    """The sum over neighbouring characters of how likely their pair is; the characters are taken apart once."""
    table = F.split(F.lit(",".join(map(str, pairs))), ",").cast("array<int>")  # a constant: folded once
    at = lambda ch: F.instr(F.lit(LETTERS), ch)
    places = F.transform(F.filter(F.split(low, ""), lambda ch: ch != ""), at)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.get(table, a["last"] * (len(LETTERS) + 1) + i)).alias("sum"))
    first = F.get(table, F.instr(F.lit(LETTERS), F.left(low, F.lit(1))))  # what the start value adds before the first character
    return F.aggregate(places, start, step, lambda a: a["sum"]) - first


def features(c: Column, left: Column, right: Column, pairs: list[int], words: list[str]) -> Column:
    """An array of FEATURES doubles."""
    size, low = F.greatest(F.length(c), F.lit(1)), F.lower(c)
    mean = _likely_pairs(low, pairs) / size
    parts = F.split(low, "[^a-z]+")
    covered = F.aggregate(parts, F.lit(0), lambda a, p: a + F.when((F.length(p) >= 2) & p.isin(words), F.length(p)).otherwise(0))
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    near = F.lower(left)
    changes = F.regexp_count(c, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"))
    every = [
        F.length(c),
        _share(_only(c, "0-9"), c),
        _share(_only(c, "A-Z"), c),
        _share(_only(c, "a-z"), c),
        changes / size,
        mean,
        covered / size,
        _share(_only(c, "/"), c),
        _share(_only(c, r".\-_"), c),
        flag(left.rlike(r"[/.@#&?%:\-]$")),
        flag(left.rlike(r"""([=:]|=>|:=)\s*["'`]?$""")),
        flag(near.rlike(f"({SECRET_WORDS})[^\\n]{{0,16}}$")),
        flag(near.rlike(f"({OTHER_WORDS})[^\\n]{{0,12}}$")),
        F.size(F.array_distinct(F.split(c, ""))) / size,
        flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        flag(right.rlike(r"""^["'`]""")),
        flag(near.rlike("(example|sample|dummy|your|placeholder)") | low.rlike("(example|sample|dummy|your|changeme|placeholder|xxxx)")),
    ]
    return F.array(*[x.cast("double") for x in every])


def _tree(lines: list[tuple[int, str]], at: int):
    """A nested list (feature, bar, left, right), or a number, from a printed tree; and the next line."""
    depth, line = lines[at]
    if line.startswith("Predict"):
        return float(line.split(":")[1]), at + 1
    feature, bar = re.search(r"feature (\d+) <= (\S+)\)", line).groups()
    left, at = _tree(lines, at + 1)
    right, at = _tree(lines, at + 1)
    return (int(feature), float(bar), left, right), at


def read_forest(printed: str) -> list:
    trees, lines = [], []
    for line in [*printed.splitlines(), "Tree"]:
        body = line.strip()
        if body.startswith("Tree"):
            if lines:
                trees.append(_tree(lines, 0)[0])
            lines = []
        elif re.match("If|Else|Predict", body):
            lines.append((len(line) - len(line.lstrip()), body))
    return trees


def vote(trees: list, x: Column) -> Column:
    """The share of trees that call the features ``x`` a secret."""

    def case(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(F.get(x, F.lit(t[0])) <= t[1], case(t[2])).otherwise(case(t[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + case(t)
    return total / len(trees)


def candidates(text: Column) -> tuple[Column, Column]:
    """The candidates of a text and the pieces between them (one more)."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _context(found: Column, pieces: Column, pairs: list[int], words: list[str]) -> Column:
    """An array of features, one entry for each candidate."""
    return F.transform(found, lambda c, i: features(c, F.right(F.get(pieces, i), F.lit(48)), F.left(F.get(pieces, i + 1), F.lit(16)), pairs, words))


def labelled_findings(sample: DataFrame) -> DataFrame:
    """text, label (1: a secret): findings made by rule around the words of each sampled text."""
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) > 1)
    base = sample.select("n", words.alias("w")).filter(F.size("w") > 0)
    word = lambda i: F.element_at("w", (F.pmod(F.xxhash64("n", F.lit(i)), F.size("w")) + 1).cast("int"))
    key = lambda i: F.concat_ws("-", F.lit("finding"), F.col("n"), F.lit(i))
    glue = lambda sep, *ids: F.concat_ws(sep, *[F.lower(word(i)) for i in ids])
    b64 = lambda i: F.base64(F.unhex(F.sha2(key(i), 256)))
    alnum = lambda i: _only(b64(i), "A-Za-z0-9")
    lit = F.lit
    low = lambda i: F.lower(word(i))
    hexes = lambda i, n: F.substring(F.md5(key(i)), 1, n)
    secrets = [
        (' token = "', F.sha1(key(1)), '" '), (' TOKEN = "', F.upper(F.sha1(key(2))), '"!! '), (" api_key: '", F.md5(key(3)), "' "), (" secret=", F.sha2(key(4), 256), "\n"),
        (' "password": "', b64(5), '", '), (" AWS_ACCESS_KEY = ", F.concat(lit("AKIA"), F.upper(F.substring(F.md5(key(6)), 1, 16))), " "), (" Authorization: Bearer ", F.concat(lit("ghp_"), F.substring(alnum(7), 1, 36)), " "),
        (" client_key = `", F.concat(lit("sk_live_"), F.substring(alnum(8), 1, 24)), "` "), (" access_key := \"", F.substring(alnum(9), 1, 40), '" '), (" ", F.concat(lit("xoxb-"), F.conv(F.substring(F.md5(key(10)), 1, 10), 16, 10), lit("-"), F.substring(alnum(11), 1, 24)), " "),
        (" password: ", F.concat(low(12), lit("#"), hexes(13, 5)), " "), (' db_password = "', F.concat(F.initcap(word(14)), hexes(15, 3), lit("!")), '" '), (" pwd=", F.substring(alnum(16), 1, 10), "\n"), (" secret: ", F.concat(F.upper(hexes(17, 4)), lit("@"), low(18), hexes(19, 3)), " "),
        (" api_key=", F.substring(alnum(20), 1, 14), " "), (" auth_token: '", hexes(120, 12), "' "), (" passwd := ", F.concat(lit("$"), F.substring(b64(121), 1, 9), lit("%&")), " "), (" credential=", F.concat(low(122), hexes(123, 6)), " "),
    ]
    others = [
        (" commit ", F.sha1(key(21)), " "), (" sha256:", F.sha2(key(22), 256), " "), (" checksum = ", F.md5(key(23)), " "), (' integrity="', F.concat(lit("sha512-"), b64(24)), '" '),
        (" uuid ", F.regexp_replace(F.md5(key(25)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), " "), (" https:", F.concat(lit("//"), glue("/", 26, 27, 28, 29, 30), lit(".html")), " "),
        (" /blob/", F.concat(F.sha1(key(31)), lit("/"), glue("/", 32, 33)), " "), (" file ", F.concat(lit("/usr/lib/"), glue("/", 34, 35, 36), lit(".so.1")), " "), (" ", glue("", 37, 38, 39, 40, 41, 42), " "), (" ", F.upper(glue("", 43, 44, 45, 46, 47, 48)), "!! "),
        (" def ", glue("_", 49, 50, 51, 52, 53), "(): "), (' api_key = "', F.concat(lit("your_api_key_"), glue("_", 54, 55)), '" '), (' token = "', F.repeat(lit("x"), 24), '" '), ("\n", F.repeat(lit("="), 40), "\n"), ("\n", F.repeat(lit("-"), 32), "\n"), (' token = "', F.concat(lit("EXAMPLE"), F.sha1(key(56))), '" '), (" ", F.repeat(lit("0123456789"), 3), " "), (" <a href=\"", F.concat(lit("/static/"), F.md5(key(57)), lit(".css")), '"> '),
        (" password: ", F.concat(low(58), lit("word")), " "), (' token = "', glue("_", 59, 130), '" '), (" auth: ", glue(".", 131, 132), "\n"), (" secret = ", F.concat(lit("get_"), low(133), lit("("), low(134), lit(")")), "\n"),
        (' password = "', lit("********"), '" '), (" pwd=", lit("changeme"), " "), (" token: ", F.concat(lit("<your-"), low(135), lit(">")), " "), (" credential: ", F.concat(low(136), lit("ation,")), " "), (" authors: ", glue(",", 137, 138), " "), (" secret: ", F.concat(low(139), lit("-"), low(140), lit("!!")), " "),
    ]
    rows = [F.struct(F.concat(word(60 + i), lit(a), v, lit(b), word(90 + i)).alias("text"), lit(y).alias("label")) for i, (a, v, b, y) in enumerate([*[(*s, 1.0) for s in secrets], *[(*o, 0.0) for o in others]])]
    return base.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def sampled(df: DataFrame, text_col: str, rows: int, seed: int) -> DataFrame:
    """n, text: a slice of each of the ``rows`` distinct texts of smallest hash."""
    text, size = F.col(text_col), F.greatest(F.length(text_col) - SLICE, F.lit(0)) + 1
    part = F.substring(text, (F.pmod(F.xxhash64(text, F.lit(seed)), size) + 1).cast("int"), F.lit(SLICE))
    some = df.filter(text.isNotNull())
    bar = some.select(F.xxhash64(text).alias("n")).distinct().orderBy("n").limit(rows).agg(F.max("n")).first()[0]
    return kept(some.filter(F.xxhash64(text) <= F.lit(bar)).select(F.xxhash64(text).alias("n"), part.alias("text")).groupBy("n").agg(F.min("text").alias("text")))


def fit(df: DataFrame, text_col: str = "text", sample_rows: int = 400, dictionary_words: int = 2000, trees: int = 20, depth: int = 6, seed: int = 7) -> Forest | None:
    """Trains the forest; None if no text has a word."""
    sample = sampled(df, text_col, sample_rows, seed).coalesce(1).sortWithinPartitions("n")
    words = df.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("word")).filter("length(word) > 1")
    words = kept(words.groupBy("word").count())
    listed = [r.word for r in words.orderBy(F.desc("count"), "word").limit(dictionary_words).collect()]
    if not listed:
        return None
    letters = words.select("count", F.filter(F.split("word", ""), lambda ch: ch != "").alias("ch"))
    pair = letters.select("count", F.explode(F.zip_with(F.slice("ch", 1, F.size("ch") - 1), F.slice("ch", 2, F.size("ch") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {r.pair: r.n for r in pair.groupBy("pair").agg(F.sum("count").alias("n")).collect()}  # 26 x 26 at most
    most = max(counts.values())
    signs = " " + LETTERS
    table = [int(89 * (counts.get(a + b, 0) / most) ** 0.5) for a in signs for b in signs]
    found = labelled_findings(sample)
    match, pieces = candidates(F.col("text"))
    rows = found.select("label", match.alias("c"), pieces.alias("p")).filter(F.size("c") > 0)
    rows = rows.select("label", array_to_vector(F.get(_context(F.col("c"), F.col("p"), table, listed), F.lit(0))).alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featureSubsetStrategy="onethird").fit(rows)
    return Forest(read_forest(model.toDebugString), table, listed)


def scanned(df: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with _found (candidates), _pieces (what is between them) and _scores (the forest's votes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    match, pieces = candidates(text)
    out = df.withColumn("_found", match)
    out = out.withColumn("_pieces", F.when(F.size("_found") > 0, pieces).otherwise(none))
    if forest is None:
        return out.withColumn("_scores", F.transform("_found", lambda c: F.lit(0.0)))
    out = out.withColumn("_features", _context(F.col("_found"), F.col("_pieces"), forest.pairs, forest.words))
    return out.withColumn("_scores", F.transform("_features", lambda x: vote(forest.trees, x))).drop("_features")


def findings(df: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text", bar: float = BAR) -> DataFrame:
    """One row per candidate: doc_id, start (characters before it), length, candidate, score, secret."""
    done = scanned(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), forest).filter(F.size("_found") > 0)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a.at + F.length(x.p) + F.length(x.c)).alias("at"), F.array_append(a.out, a.at + F.length(x.p)).alias("out"))
    both = F.zip_with(F.slice("_pieces", 1, F.size("_found")), "_found", lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    done = done.withColumn("_starts", F.aggregate(both, start, step, lambda a: a.out))
    rows = done.select("doc_id", F.explode(F.arrays_zip("_starts", "_found", "_scores")).alias("f"))
    return rows.select("doc_id", F.col("f._starts").alias("start"), F.length("f._found").alias("length"), F.col("f._found").alias("candidate"), F.col("f._scores").alias("score"), (F.col("f._scores") >= bar).alias("secret"))


def redacted(df: DataFrame, forest: Forest | None, text_col: str = "text", bar: float = BAR) -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by a mark; other texts stay as they are."""
    done = scanned(df, forest, text_col)
    said = F.zip_with("_found", "_scores", lambda c, s: F.when(s >= bar, F.lit(MARK)).otherwise(c))
    clean = F.array_join(F.zip_with("_pieces", F.array_append(said, F.lit("")), lambda p, c: F.concat(p, c)), "")
    return done.withColumn(text_col, F.when(F.exists("_scores", lambda s: s >= bar), clean).otherwise(F.col(text_col))).select(*df.columns)
