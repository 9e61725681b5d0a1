"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A list has prefix rules ``(host, path, verdict)``, which fit their host, its
subdomains and all paths that start with theirs, and whole canonical URLs that
are blocked. Every entry has a key. A URL is asked for the keys that could fit it:
one for each pair of (host labels, path length) that occurs in the list, and its own
canonical form. Keys that pass the Bloom filter meet the list in a hash join,
which takes out false positives; the longest rule that is left wins.

The filter never holds more than ``MOST_BLOCKS`` blocks of 64 bytes. A longer list
fills it and lets more keys pass; the join stays exact. All of it is Spark SQL.

A null URL or one without ``://`` has an empty host and path and is fitted by a rule
with an empty host only. Of two rules of one length the longer host wins, of equal
rules ``block``. Repeated rows each keep their verdict; an empty list allows all.
List entries without a host, path or verdict are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hingeworks.llm.tables import written

BITS_PER_KEY = 12
MOST_BLOCKS = 1 << 15
_LANES = 8  # 64-bit words of a block; a key sets one bit in each
SALTS = 16

# A-Z alone are lower-cased.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a default port, and path without a slash at its end; query and fragment are gone."""
    return F.concat(F.regexp_replace(host, ":(80|443)$", ""), F.regexp_replace(path, "/$", ""))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("r"), host, path)


def _url_key(address: Column) -> Column:
    return F.concat(F.lit("u"), address)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``(key, rule, host_chars, verdict, labels, chars)``, one row a key.

    ``rules`` has ``(host, path, verdict)``, ``listed`` has ``(address)`` in canonical form.
    """
    own = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict"))  # "block" after "allow"
    named = own.select(
        _rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"), "verdict",
        F.size(F.split("host", "\\.", -1)).alias("labels"), F.length("path").alias("chars"))
    none = F.lit(None)
    whole = listed.where("address is not null").select("address").distinct().select(
        _url_key(F.col("address")).alias("key"), none.cast("string").alias("rule"),
        none.cast("int").alias("host_chars"), F.lit("block").alias("verdict"),
        none.cast("int").alias("labels"), none.cast("int").alias("chars"))
    return named.unionByName(whole)


class BlockedBloom:
    """A filter of at most ``MOST_BLOCKS`` blocks, held as one array of 64-bit words.

    A key has one block, and in each of its words the bit that six bits of a second hash name.
    """

    def __init__(self, keys: DataFrame, rows: int):
        wanted = max(1, -(-rows * BITS_PER_KEY // (64 * _LANES)))
        self.blocks = min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())
        words = [F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("key"), i))
                 for i in range(_LANES)]
        held = keys.select(self._block(F.col("key")).alias("block"), *(
            w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(
                F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_LANES)))
        every = keys.sparkSession.range(self.blocks).select(F.col("id").alias("block")).join(held, "block", "left")
        block = F.struct("block", F.array(*(F.coalesce(f"w{i}", F.lit(0).cast("long"))
                                            for i in range(_LANES))).alias("words"))
        # One array of at most 2 MB, whatever the list.
        self.words = every.agg(F.flatten(F.transform(
            F.array_sort(F.collect_list(block)), lambda b: b["words"])).alias("words")).scalar()

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    @staticmethod
    def _bit(key: Column, lane: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * lane).bitwiseAND(F.lit(63)).cast("int")

    def passes(self, key: Column) -> Column:
        """Whether the key may be in the list; true for every key that is."""
        place, passes = self._block(key).cast("int") * _LANES, F.lit(True)
        for i in range(_LANES):
            word = F.get(self.words, place + i)
            held = F.call_function("shiftrightunsigned", word, self._bit(key, i)).bitwiseAND(F.lit(1)) == 1
            passes = passes & held
        return passes


def _salted(keys: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; its own columns of these names are replaced."""
    known = written(entries(rules, listed), "url_list")
    rows, shapes = known.agg(F.count(F.lit(1)), F.collect_set(F.when(
        F.col("labels").isNotNull(), F.struct("labels", "chars")))).first()  # distinct lengths, not rules
    parts = pages.drop("host", "path", "rule", "verdict").withColumn(
        "host", host_of(F.col(url).cast("string"))).withColumn("path", path_of(F.col(url).cast("string")))

    # One row a distinct address, however many pages have it.
    addresses = parts.select("host", "path").distinct()
    fitting = [
        F.when((F.size(F.split("host", "\\.", -1)) >= labels) & (F.length("path") >= chars), _rule_key(
            F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))
        for labels, chars in sorted(tuple(s) for s in shapes)
    ]
    own = _url_key(canonical(F.col("host"), F.col("path")))
    asked = addresses.select("host", "path", F.explode(F.array(own, *fitting)).alias("key")).where("key is not null")
    bloom = BlockedBloom(known.select("key"), rows)
    possible = written(asked.where(bloom.passes(F.col("key"))), "url_possible")

    # The list meets distinct keys; what is confirmed then meets every address, salted,
    # as one short rule may fit a third of them.
    confirmed = known.select("key", "rule", "host_chars", "verdict").join(
        possible.select("key").distinct().hint("shuffle_hash"), "key")
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    fits = possible.withColumn("salt", salt).join(_salted(confirmed).hint("shuffle_hash"), ["key", "salt"])
    longest = F.max(F.struct(F.col("rule").isNotNull().alias("by_rule"), F.length("rule").alias("chars"),
                             "host_chars", "rule", "verdict"))
    verdicts = written(fits.groupBy("host", "path").agg(longest.alias("best")).select(
        "host", "path", "best.rule", "best.verdict"), "url_verdicts")

    # One address may be that of a third of the pages. There is a verdict for nearly every
    # address, so pages and verdicts are merged; Spark splits the pages of a hot address.
    columns = [c for c in parts.columns if c not in ("host", "path")]
    judged = parts.join(verdicts.hint("merge"), ["host", "path"], "left")
    return judged.select(*(F.col(f"`{c}`") for c in columns), "host", "path", "rule",
                         F.coalesce("verdict", F.lit("allow")).alias("verdict"))
