"""Secret scans with linking of credentials in several parts (operator 13, DataFrame functions only).

Strong finds (assigned secrets, access identifiers, long hexadecimal runs) are
reported wherever they stand. Weak candidates (a user name, a short or unusual
secret, an endpoint) are common in clean texts, so they are reported only where
complementary parts stand together: an identifier with a secret, a secret with an
identifier or an endpoint, an endpoint with both, strong finds counting as parts too.
Parts stand together if they lie in one scope, the text between two blank lines, and
at most REACH code points apart.

Places come from the pieces between matches: the lengths of what split() leaves and of what
regexp_extract_all() finds, summed up along the text. The join of intervals is
a sweep: sorted by place, each candidate meets the nearest part of each sort on
either side, by running extremes in both directions, so no pair is made but the
nearest. Lengths and flags are what is shuffled, once, by the text's row; weak
patterns are located only in texts that hold a secret and a complement.

Defined results: a null or empty text has no spans, and the digest of an
empty string; rows that repeat a key are rows of their own; of overlapping finds of
different strong kinds both stay, a weak candidate that overlaps a strong find is part
of that and not reported; equal distances are no matter; a text of any length is
searched whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of spans in the order in which they are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_BREAK = len(KINDS)
#: How many code points may lie between parts of one credential.
REACH = 200


def _either_case(word: str) -> str:
    """A pattern for word in which A-Z and a-z are one; other characters stay as they are."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in word)


def _named(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(_either_case, words)) + ")"


_IS = r"""["']?\x20*[:=]\x20*["']?"""

#: The strong kinds. Lengths are checked after the match, where a longer match cannot start later.
_ASSIGNED = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN, LEAST_VALUE = f"({'|'.join(map(_either_case, _ASSIGNED))}){_IS}([A-Za-z0-9+/_.=-]+)", 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

#: The weak kinds, in one pattern, so that candidates never overlap: an identifier, a secret, an endpoint.
IDENTIFIER = _named(("user", "user_?name", "user_?id", "login", "account", "account_?id", "client_?id", "key_?id")) + _IS + r"[A-Za-z0-9@._+-]{2,}|AKIA[A-Z0-9]{4,}"
SECRET = _named((*_ASSIGNED, "pass", "pwd", "passphrase", "credential", "auth", "bearer", "secret_?key", "access_?key", "private_?key")) + _IS + r"[A-Za-z0-9+/_.=-]{4,}|[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|ftp|sftp|ssh|s3|jdbc|postgres|postgresql|mysql|redis|mongodb|amqp)://[A-Za-z0-9._:@/-]+|" + _named(("host", "hostname", "endpoint", "server")) + _IS + r"[A-Za-z0-9.-]+(?::[0-9]{1,5})?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?"
WEAK = f"({IDENTIFIER})|({SECRET})|({ENDPOINT})"
BLANK_LINE = r"\n[\x20\x09\x0D]*\n"


#: The matchers: the pattern and the kind of each.
_MATCHERS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK, "break": BLANK_LINE}
_NONE = "array<struct<kind:int,n:int,gap:int,size:int,good:boolean>>"


def _columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, each worked out once: a generator keeps Spark from putting the expressions in the place of each use, as inside a lambda, where they would be for each match."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _matches(name: str, kind, good) -> Column:
    """An array of (kind, n, gap, size, good): a matcher's matches in order, with the length of what lies before each since the last."""
    gaps = f"_gaps_{name}"
    return F.transform(f"_found_{name}", lambda x, i: F.struct(kind(i).cast("int").alias("kind"), i.alias("n"), F.get(gaps, i).alias("gap"), F.length(x).alias("size"), good(x, i).alias("good")))


def _candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row, key and a match each; a row without kind for a text that has none."""
    t = F.col("_text")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    linked = (t.rlike(SECRET) | t.rlike(HEX)) & (t.rlike(IDENTIFIER) | t.rlike(ENDPOINT))
    # weak candidates and blank lines are located only where there may be something to link
    rows = _columns(rows, {"_linked": linked})
    rows = _columns(rows, {f"_has_{n}": t.rlike(p) if n in KINDS else F.col("_linked") & t.rlike(p) for n, p in _MATCHERS.items()})
    found = {f"_found_{n}": F.when(F.col(f"_has_{n}"), F.regexp_extract_all(t, F.lit(p), F.lit(0))) for n, p in _MATCHERS.items()}
    found |= {f"_gaps_{n}": F.when(F.col(f"_has_{n}"), F.transform(F.split(t, p, -1), lambda x: F.length(x))) for n, p in _MATCHERS.items()}
    groups = {"_value": ("assign", ASSIGN, 2), "_one": ("weak", WEAK, 1), "_two": ("weak", WEAK, 2)}
    found |= {c: F.when(F.col(f"_has_{n}"), F.regexp_extract_all(t, F.lit(p), F.lit(g))) for c, (n, p, g) in groups.items()}
    rows = _columns(rows, found)
    weak = lambda i: F.when(F.get("_one", i) != "", 3).when(F.get("_two", i) != "", 4).otherwise(5)
    mixed = lambda x: x.rlike("[:=]|\\.") | (x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    fixed = lambda k: (lambda i: F.lit(k))
    yes = lambda x, i: F.lit(True)
    lists = [
        _matches("assign", fixed(0), lambda x, i: F.length(F.get("_value", i)) >= LEAST_VALUE),
        _matches("access", fixed(1), yes),
        _matches("hex", fixed(2), yes),
        _matches("weak", weak, lambda x, i: (weak(i) != 4) | mixed(x)),
        _matches("break", fixed(_BREAK), yes),
    ]
    every = F.concat(*[F.coalesce(c, F.array().cast(_NONE)) for c in lists])
    return rows.select("_row", "_key", F.explode_outer(every).alias("m")).select("_row", "_key", "m.*")


def _located(candidates: DataFrame) -> DataFrame:
    """_row, _key, kind, start and stop (exclusive), in code points; kind is null in the row of a text without any."""
    # one exchange: windows and groups by the row need no other. The three matchers of a text are told apart by their class
    dealt = candidates.repartition("_row").withColumn("_class", F.when(F.col("kind").between(3, 5), 3).otherwise(F.col("kind")))
    along = Window.partitionBy("_row", "_class").orderBy("n")
    stop = F.sum(F.col("gap").cast("long") + F.col("size")).over(along)
    return dealt.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).drop("_class", "n", "gap", "size")


def _link(parts: DataFrame, reach: int) -> DataFrame:
    """parts with linked: whether a strong find, or a weak candidate whose complements stand near."""
    order, back = ["start", "kind"], [F.desc("start"), F.desc("kind")]
    scoped = parts.withColumn("_scope", F.sum((F.col("kind") == _BREAK).cast("long")).over(Window.partitionBy("_row").orderBy(*order))).filter(f"kind IS NULL OR kind < {_BREAK}")
    behind = Window.partitionBy("_row", "_scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_row", "_scope").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    strong = F.col("kind") < 3
    sorts = {"_base": strong, "_identifier": F.col("kind").isin(1, 3), "_secret": F.col("kind").isin(0, 2, 4), "_endpoint": F.col("kind") == 5}

    def nearest(df: DataFrame, names: list[str]) -> DataFrame:
        """The stop of the nearest earlier part of each sort, and the start of the nearest later one."""
        for n in names:
            df = df.withColumn(f"{n}_stop", F.max(F.when(sorts[n], F.col("stop"))).over(behind))
        for n in names:
            df = df.withColumn(f"{n}_start", F.min(F.when(sorts[n], F.col("start"))).over(ahead))
        return df

    def near(name: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_stop") <= reach, F.lit(False)) | F.coalesce(F.col(f"{name}_start") - F.col("stop") <= reach, F.lit(False))

    overlaps = F.coalesce(F.col("_base_stop") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_base_start") < F.col("stop"), F.lit(False))
    apart = nearest(scoped, ["_base"]).withColumn("kind", F.when(strong | ~overlaps, F.col("kind")))
    placed = nearest(apart, ["_identifier", "_secret", "_endpoint"])
    linked = (
        F.when(F.col("kind") == 3, near("_secret"))
        .when(F.col("kind") == 4, near("_identifier") | near("_endpoint"))
        .when(F.col("kind") == 5, near("_identifier") & near("_secret"))
        .otherwise(strong)
    )
    return placed.select("_row", "_key", "kind", "start", "stop", F.coalesce(linked, F.lit(False)).alias("linked"))


def _judged(docs: DataFrame, key: str, text: str, reach: int) -> DataFrame:
    located = _located(_candidates(docs, key, text))
    # a match that fails has done its work once places are known; its row stays without a kind, as the text may have no other
    return _link(located.withColumn("kind", F.when(F.col("good"), F.col("kind"))), reach)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """key, kind, start and stop of every span reported; stop is exclusive, both count code points."""
    names = F.array(*map(F.lit, KINDS))
    return _judged(docs, key, text, reach).filter("linked").select(F.col("_key").alias(key), F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "stop")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    names = F.array(*map(F.lit, KINDS))
    listed = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")
    one = F.struct("start", "kind", "stop")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(3)]
    grouped = _judged(docs, key, text, reach).groupBy("_row", "_key").agg(*counts, F.collect_list(F.when(F.col("kind") < 3, one)).alias("_base"), F.collect_list(F.when(F.col("linked"), one)).alias("_all"))
    return grouped.select(F.col("_key").alias(key), *[f"n_{k}" for k in KINDS[:3]], F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))
