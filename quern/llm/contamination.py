"""Same or near-same records across splits.

1. Questions are cut into words, numbers and Chinese characters, in one way of
   writing (compatibility forms, case, accents, contractions), without courtesy and
   function words. Words that are a slip of a common word are read as that word.
2. The words left are hashed to a 64-bit similarity fingerprint, weighted by rarity,
   numbers most. Equal questions on one side of the split are one class.
3. The code is cut into ``BLOCKS`` segments. Two codes within ``RADIUS`` bits agree
   in at least ``BLOCKS - RADIUS`` segments, so codes are joined across the splits
   on each choice of ``BLOCKS - RADIUS`` segments, and pairs beyond the radius are
   dropped. A pair counts under its first choice only. A block that many questions
   share is dealt into pieces, and each piece of one side meets each of the other in
   a task of its own.
4. The texts of the pairs left are compared word by word: numbers, single letters
   and negations must agree, and any other difference must be a slip of the pen.
5. Pairs of classes are expanded to ids and counted by split and source.

Defined results: null and blank questions ask nothing and are in no pair; rows with
a null split or id are in none. Rows repeated whole count once. An evaluation
question may meet any number of training questions. All pairs of ids are returned
unless two texts, exactly as stored, have more than ``EXPAND`` of them: then each id
is paired with the other text's first id. Counts are of all pairs. Other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.textarrays import mix
from quern.operators.skew import merged
from quern.session import table, write_once

#: Words in at least this share of the questions are common; there are at most (words a question) / SHARE of them.
SHARE = 0.0005
#: A word is a slip of another that is so many times as frequent.
SLIP_RATIO = 12
#: Chinese characters in a smaller share of the questions have no weight in the code.
RARE_CHARACTER = 0.01
#: Segments of the code, and bits in which codes may differ.
BLOCKS, RADIUS = 7, 5
#: Pairs of ids written out for a pair of stored texts.
EXPAND = 10_000
#: Members of a block of codes, or copies of a text, that one task takes at once.
BLOCK = 1000
#: Questions whose codes are made at once.
SLICE = 4096

# Words of courtesy, which may stand before or within a question.
COURTESY = re.compile(
    r"\b(?:please tell me|could you tell me|can you tell me|quick question|excuse me|please|hi|hello|hey|thanks|thank you|"
    r"bitte|kurze frage|hallo|guten tag|danke|bonjour|salut|s'il vous plait|s'il te plait|merci|petite question|"
    r"por favor|ola|oi|bom dia|obrigado|obrigada|pergunta rapida)\b|您好|你好|请问|麻烦(?:查一?下)?|请查一?下|查一?下|谢谢"
)
# Contractions and forms with another way of writing.
FORMS = [
    (re.compile(r"\bwhat's\b"), "what is"),
    (re.compile(r"\bn't\b|(?<=[a-z])n't\b"), " not"),
    (re.compile(r"\bqu'|\bl'|\bd'|\bj'|\bn'(?=est)"), " "),
    (re.compile("为什么|為什麼"), "何故"),
    (re.compile("怎么样|怎样"), "怎么"),
    (re.compile("多少号"), "多少"),
    (re.compile("为(?=多少|何|什)"), "是"),
    (re.compile("里"), "中"),
]
# Words that carry no content; single letters other than these name places.
FUNCTION = set(
    "the a an of at in for is to on s und der die das den dem des im fur ist le la les du de des dans au aux un une est ce se o os as do da dos das no na nos nas em e um uma t".split()
) | set("的在了一呢吗吧啊呀之于")
# Words that turn a question's sense.
NEGATIONS = set("not never no-one nothing without nicht nie kein keine keinen ohne pas jamais sans nao nunca sem".split()) | set("不没未无非否莫")

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*|[㐀-鿿]")
_CJK = re.compile("[㐀-鿿]")


def written(query: str) -> str:
    """One way of writing: compatibility forms, no case, no accents, no courtesy."""
    q = unicodedata.normalize("NFKC", query).casefold().replace("’", "'").replace("‘", "'")
    q = "".join(c for c in unicodedata.normalize("NFD", q) if not unicodedata.combining(c))
    q = unicodedata.normalize("NFC", q)
    q = re.sub(r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "", " ".join(q.split()))
    for pattern, form in FORMS:
        q = pattern.sub(form, q)
    return COURTESY.sub(" ", q)


def words(query: str) -> list[str]:
    """Words, numbers and Chinese characters in order, function words left out."""
    return [t for t in _TOKEN.findall(written(query)) if t not in FUNCTION]


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words (insert, drop, replace, swap neighbours), ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return min(row[-1], most + 1)


def _drops(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


class Lexicon:
    """Common words with their counts; reads slips as the word meant."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.counts, self.total = counts, max(1, total)
        self.floor = max(1, int(SHARE * total))
        self.near: dict[str, list[str]] = {}
        for w in counts:
            if len(w) >= 4 and w.isalpha() and not _CJK.search(w):
                for d in _drops(w):
                    self.near.setdefault(d, []).append(w)
        self.memo: dict[str, str] = {}

    def count(self, w: str) -> int:
        return self.counts.get(w, self.floor)

    def meant(self, w: str) -> str:
        """The common word that a rare one is a slip of, or the word itself."""
        if len(w) < 4 or not w.isalpha() or _CJK.search(w):
            return w
        if w not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            near = {c for d in _drops(w) for c in self.near.get(d, ()) if c != w and self.counts[c] >= SLIP_RATIO * self.count(w) and distance(w, c, 1) == 1}
            self.memo[w] = max(near, key=lambda c: (self.counts[c], c)) if near else w
        return self.memo[w]

    def canonical(self, query: str) -> list[str]:
        return [self.meant(w) for w in words(query)]

    def weight(self, w: str) -> float:
        if w.isdigit():
            return 12.0
        if _CJK.match(w) and self.count(w) < RARE_CHARACTER * self.total:
            return 0.0  # a rare character is a slip of some other more often than not; the texts are compared later
        return min(8.0, float(np.log(self.total / self.count(w))))


def fingerprints(questions: list[list[str]], lex: Lexicon) -> list[int]:
    """The signs of the weighted sum of the words' hash bits, for many questions at once.

    A question whose words all have no weight counts them equally; one without words has 0.
    """
    known: dict[tuple[str, int], int] = {}
    at, owner = [], []
    for k, tokens in enumerate(questions):
        for w, n in sorted(Counter(tokens).items()):
            at += [known.setdefault((w, i), len(known)) for i in range(n)]
            owner += [k] * n
    out = np.zeros(len(questions), np.uint64)
    if at:
        h = mix(np.array([xxhash.xxh64_intdigest(f"{w}\0{i}") for w, i in known], np.uint64))
        signs = (h[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64) * 2 - 1
        weights = np.array([lex.weight(w) for w, _ in known])[at]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        bare = np.add.reduceat(weights, first) == 0
        weights[np.repeat(bare, np.diff(np.append(first, len(at))))] = 1.0
        total = np.add.reduceat(signs[at] * weights[:, None], first)
        out[np.array(owner)[first]] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.tolist()


def same_question(a: list[str], b: list[str], lex: Lexicon) -> bool:
    """Whether two questions have the same words but for slips of the pen."""
    ca, cb = Counter(a), Counter(b)
    left, right = list((ca - cb).elements()), list((cb - ca).elements())
    if not left and not right:
        return True
    if len(left) > 3 or len(right) > 3 or len(left) + len(right) > 0.34 * max(len(a), len(b)) + 1:
        return False
    for w in left + right:
        if w.isdigit() or w in NEGATIONS or len(w) == 1 and not _CJK.match(w) or any(c.isdigit() for c in w):
            return False
    cjk = [w for w in left + right if _CJK.match(w)]
    if cjk:
        if len(cjk) < len(left) + len(right):
            return False
        return _slip_of_characters(a, b, left, right, lex)
    if len(left) != len(right):
        return False
    for w in left:
        near = [v for v in right if _slip(w, v, lex)]
        if not near:
            return False
        right.remove(near[0])
    return True


def _slip(w: str, v: str, lex: Lexicon) -> bool:
    known = [w in lex.counts, v in lex.counts]
    if all(known):
        few, many = sorted((lex.counts[w], lex.counts[v]))
        return many >= SLIP_RATIO * few and len(w) >= 4 and distance(w, v, 1) == 1
    most = 2 if not any(known) and min(len(w), len(v)) >= 6 else 1
    return min(len(w), len(v)) >= 4 and distance(w, v, most) <= most


def _slip_of_characters(a: list[str], b: list[str], left: list[str], right: list[str], lex: Lexicon) -> bool:
    """One character dropped, or one replaced such that only one of the two readings is common."""
    if len(left) > 1 or len(right) > 1:
        return False

    def context(tokens: list[str], c: str) -> int:
        """How common the rarest pair with the character is."""
        pairs = [x + y for x, y in zip(tokens, tokens[1:]) if c in (x, y) and _CJK.match(x) and _CJK.match(y)]
        return min((lex.count(p) for p in pairs), default=lex.floor)

    if left and right:
        x, y = context(a, left[0]), context(b, right[0])
        few, many = min(x, y), max(x, y)
        return many >= SLIP_RATIO * few and many >= 0.002 * lex.total
    longer, c = (a, left[0]) if left else (b, right[0])
    # The dropped character stands in a common word; names of places are told by each of theirs.
    return context(longer, c) >= 0.002 * lex.total


def worded(questions: DataFrame) -> DataFrame:
    """``id, side, split, source, text, raw``: the words of questions that ask something; ``text`` is a hash. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [words(q) if q else [] for q in b.column(5).to_pylist()]
            some = pa.array([bool(r) for r in raw], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(raw, pa.list_(pa.string()))], ["id", "side", "split", "source", "text", "raw"]).filter(some)

    cols = questions.select("id", "side", "split", "source", F.xxhash64("query").alias("text"), "query").where("query <> ''")
    return write_once(cols.mapInArrow(run, "id string, side string, split string, source string, text long, raw array<string>"), "words")


def lexicon(worded: DataFrame) -> Lexicon:
    """Common words and Chinese pairs over all questions. Only words above the share come to the driver, which bounds their number."""
    cjk = lambda c: c.rlike("^[㐀-鿿]")
    nexts = F.zip_with("raw", F.slice("raw", 2, F.greatest(F.size("raw") - 1, F.lit(0))), lambda x, y: F.when(cjk(x) & cjk(y), F.concat(x, y)))
    counts = worded.select(F.explode(F.array_distinct(F.array_compact(F.concat("raw", nexts)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = worded.count()
    common = {r.word: r.n for r in counts.where(F.col("n") >= max(2, SHARE * total)).collect()}
    return Lexicon(common, total)


def _segments() -> list[tuple[int, int]]:
    edge = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def coded(worded: DataFrame, lex: Lexicon) -> DataFrame:
    """``side, key, text, id, split, source, cls, code, tokens, raw``: the code of each question and its class, of equal bags of words on one side."""
    held = worded.sparkSession.sparkContext.broadcast((lex.counts, lex.total))
    lexicons: list[Lexicon] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not lexicons:
            lexicons.append(Lexicon(*held.value))
        own = lexicons[0]
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                tokens = [[own.meant(w) for w in r] for r in b.column(5).to_pylist()]
                keys = [xxhash.xxh3_128_digest(" ".join(sorted(t)).encode()) for t in tokens]
                code = pa.array(np.array(fingerprints(tokens, own), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary()), code, pa.array(tokens, pa.list_(pa.string()))], [*b.schema.names, "key", "code", "tokens"])

    out = worded.mapInArrow(run, "id string, side string, split string, source string, text long, raw array<string>, key binary, code long, tokens array<string>")
    return out.select("side", "key", "text", "id", "split", "source", F.xxhash64("side", "key").alias("cls"), "code", "tokens", "raw")


def near_codes(codes: DataFrame) -> DataFrame:
    """Pairs ``t_cls, e_cls`` of the two sides whose codes differ in at most ``RADIUS`` bits (``side, cls, code``), each once."""
    bounds = _segments()
    part = [F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in bounds]
    choices = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    keys = F.array(*[F.struct(F.lit(max(c)).alias("top"), F.xxhash64(F.lit(k), *[part[i] for i in c]).alias("block")) for k, c in enumerate(choices)])
    rows = codes.select("side", "cls", "code", F.explode(keys).alias("k")).select("side", "cls", "code", "k.top", "k.block")
    pieces = lambda s: F.ceil(F.count_if(F.col("side") == s) / F.lit(BLOCK)).cast("int")
    crowds = write_once(rows.groupBy("block").agg(pieces("train").alias("t"), pieces("eval").alias("e")).where("t > 0 and e > 0 and t + e > 2"), "crowds")
    one = lambda n: F.coalesce(F.col(n), F.lit(1)).alias(n)
    whole = rows.withColumn("t", F.lit(1)).withColumn("e", F.lit(1))
    dealt = whole if crowds.isEmpty() else merged(rows, crowds, "block", "left").select(*rows.columns, one("t"), one("e"))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    train = dealt.where("side = 'train'").select("block", "top", F.col("cls").alias("t_cls"), F.col("code").alias("t_code"), own("t").alias("i"), every("e").alias("j"))
    other = dealt.where("side = 'eval'").select("block", F.col("cls").alias("e_cls"), F.col("code").alias("e_code"), own("e").alias("j"), every("t").alias("i"))
    apart = F.col("t_code").bitwiseXOR(F.col("e_code"))
    equal = [(F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << n) - 1)) == 0).cast("int") for a, n in bounds]
    # The first choice that agrees is that of the lowest equal segments.
    lower = sum((F.when(F.col("top") >= s, x).otherwise(0) for s, x in enumerate(equal)), F.lit(0))
    met = merged(train, other, ["block", "i", "j"])
    return met.where(F.bit_count(apart) <= RADIUS).where(lower == BLOCKS - RADIUS).select("t_cls", "e_cls")


def overlaps(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``side, key, text, id, split, source``) and verified pairs of classes (``train_key, eval_key``).

    ``questions`` has ``id, side`` (train or eval), ``split, source, query``.
    """
    spark = questions.sparkSession
    cut = worded(questions)
    lex = lexicon(cut)
    held = spark.sparkContext.broadcast((lex.counts, lex.total))
    rows = write_once(coded(cut, lex), "coded")
    classes = rows.groupBy("side", "cls", "key").agg(F.first("code").alias("code"), F.first(F.struct("tokens", "raw")).alias("tokens"))
    pairs = near_codes(rows.select("side", "cls", "code").distinct())
    side = lambda s: classes.where(F.col("side") == s).select(F.col("cls").alias(f"{s[0]}_cls"), F.col("key").alias(f"{s}_key"), F.col("tokens").alias(f"{s}_tokens"))
    full = merged(merged(pairs, side("train"), "t_cls"), side("eval"), "e_cls")
    lexicons: list[Lexicon] = []

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not lexicons:
            lexicons.append(Lexicon(*held.value))
        for b in batches:
            # A slip may lie as near to another common word as to the one meant, so the words as written count too.
            both = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ok = [same_question(x["tokens"], y["tokens"], lexicons[0]) or same_question(x["raw"], y["raw"], lexicons[0]) for x, y in both]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    checked = full.select("train_key", "eval_key", "train_tokens", "eval_tokens").mapInArrow(verify, "train_key binary, eval_key binary")
    return rows.select("side", "key", "text", "id", "split", "source").distinct(), write_once(checked, "overlaps")


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of ids with the evaluation side's split and source: ``train_id, eval_id, split, source``.

    All pairs, but where two texts, exactly as stored, have more than ``EXPAND``
    of them: then each copy is paired with the other text's first id only. Pairs of
    classes are expanded to pairs of texts first, so pairs that are not wanted are
    never made; texts and copies of a hot question are dealt into blocks.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    texts = members.groupBy("side", "key", "text").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))
    sizes = texts.groupBy("side", "key").agg(F.count(F.lit(1)).alias("m")).withColumn("m", blocks("m"))
    dealt = merged(texts, sizes, ["side", "key"]).withColumn("b", place("text", "m"))
    copies = merged(members, texts.select("side", "key", "text", blocks("n").alias("m")), ["side", "key", "text"]).withColumn("b", place("id", "m"))

    def of(df: DataFrame, side: str, **names: str) -> DataFrame:
        return df.where(F.col("side") == side).select(*[F.col(a).alias(b) for a, b in names.items()])

    met = merged(pairs.select("train_key", "eval_key").distinct(), of(sizes, "train", key="train_key", m="t"), "train_key")
    met = merged(met, of(sizes, "eval", key="eval_key", m="e"), "eval_key").withColumn("t", every("t")).withColumn("e", every("e"))
    met = merged(met, of(dealt, "train", key="train_key", b="t", text="t_text", n="t_n", first="t_first"), ["train_key", "t"])
    met = merged(met, of(dealt, "eval", key="eval_key", b="e", text="e_text", n="e_n", first="e_first"), ["eval_key", "e"]).drop("t", "e")
    many = F.col("t_n") * F.col("e_n") > EXPAND
    train = of(copies, "train", key="train_key", text="t_text", b="t", id="train_id")
    other = of(copies, "eval", key="eval_key", text="e_text", b="e", id="eval_id", split="split", source="source")
    one = of(members, "eval", key="eval_key", text="e_text", id="eval_id", split="split", source="source")
    with_train = lambda df: merged(df.withColumn("t", blocks("t_n")).withColumn("t", every("t")), train, ["train_key", "t_text", "t"])
    with_other = lambda df: merged(df.withColumn("e", blocks("e_n")).withColumn("e", every("e")), other, ["eval_key", "e_text", "e"])
    out = ["train_id", "eval_id", "split", "source"]
    all_ = with_other(with_train(met.where(~many))).select(*out)
    to_first = merged(with_train(met.where(many)).withColumnRenamed("e_first", "eval_id"), one, ["eval_key", "e_text", "eval_id"]).select(*out)
    of_first = with_other(met.where(many)).select(F.col("t_first").alias("train_id"), "eval_id", "split", "source")
    return all_.unionByName(to_first).unionByName(of_first).distinct()


def counted(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and source the questions that overlap and all their pairs, which are not written out: ``split, source, overlapping, pairs``."""
    keys = members.groupBy("side", "id").agg(F.count_distinct("key").alias("n_keys"))
    m = merged(members.drop("text").distinct(), keys, ["side", "id"]).withColumn("once", F.col("n_keys") == 1)
    train = m.where("side = 'train'").select(F.col("key").alias("train_key"), F.col("id").alias("train_id"), F.col("once").alias("o_t")).distinct()
    other = m.where("side = 'eval'").select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id"), "split", "source", F.col("once").alias("o_e")).distinct()
    linked = pairs.select("train_key", "eval_key").distinct()
    hit = merged(other, linked.select("eval_key").distinct(), "eval_key").groupBy("split", "source").agg(F.count_distinct("eval_id").alias("overlapping"), F.lit(0).cast("long").alias("pairs"))
    n_t = train.where("o_t").groupBy("train_key").agg(F.count(F.lit(1)).alias("n_t"))
    n_e = other.where("o_e").groupBy("eval_key", "split", "source").agg(F.count(F.lit(1)).alias("n_e"))
    plain = merged(merged(linked, n_t, "train_key"), n_e, "eval_key").groupBy("split", "source").agg(F.lit(0).cast("long").alias("overlapping"), F.sum(F.col("n_t") * F.col("n_e")).alias("pairs"))
    # An id with several texts may be in several classes, so its pairs are made distinct.
    of = lambda t, e: merged(merged(linked, t, "train_key"), e, "eval_key").select("train_id", "eval_id", "split", "source")
    rest = of(train.where("not o_t"), other).unionByName(of(train.where("o_t"), other.where("not o_e"))).distinct()
    rest = rest.groupBy("split", "source").agg(F.lit(0).cast("long").alias("overlapping"), F.count(F.lit(1)).alias("pairs"))
    return hit.unionByName(plain).unionByName(rest).groupBy("split", "source").agg(F.sum("overlapping").alias("overlapping"), F.sum("pairs").alias("pairs"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    core = table(spark, d, "core_gold").select("id", split.alias("split"), "source", "query").where(F.col("split").isin("train", "dev", "test"))
    core = core.select("id", F.when(F.col("split") == "train", "train").otherwise("eval").alias("side"), "split", "source", "query")
    # Every row of the frozen set is evaluation, whatever its split is called.
    frozen = table(spark, d, "holdout_b_gold").select("id", F.lit("eval").alias("side"), F.lit("holdout_b").alias("split"), "source", "query")
    return core.unionByName(frozen).where("id is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation question that ask the same."""
    members, pairs = overlaps(_questions(spark, d))
    return expand(members, pairs).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).where("id_a <> id_b").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: its questions, those that overlap, and pairs."""
    q = _questions(spark, d)
    members, pairs = overlaps(q)
    got = counted(members, pairs)
    every = q.where("side = 'eval'").groupBy("split", "source").agg(F.count_distinct("id").alias("questions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = every.alias("e").join(got.alias("g"), F.col("e.split").eqNullSafe(F.col("g.split")) & F.col("e.source").eqNullSafe(F.col("g.source")), "left")
    return joined.select("e.split", "e.source", "e.questions", zero("overlapping"), zero("pairs"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its class (named by its first id), the class's size and its links to classes of the other side."""
    members, pairs = overlaps(_questions(spark, d))
    sizes = members.groupBy("side", "key").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n_questions"))
    ends = [pairs.select(F.lit(s).alias("side"), F.col(f"{s}_key").alias("key")) for s in ("train", "eval")]
    links = ends[0].unionByName(ends[1]).groupBy("side", "key").agg(F.count(F.lit(1)).alias("n_links"))
    facts = merged(sizes, links, ["side", "key"], "left").select("side", "key", "class_id", "n_questions", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return merged(members.select("side", "key", "id", "split", "source").distinct(), facts, ["side", "key"]).drop("key")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
