"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest. DataFrame expressions only.

Host: what follows the first '://' up to '/', '?', '#' or the end, A-Z in lower case; path: from there up to '?', '#' or the end;
a null URL and one without '://' have both empty. A rule fits a host and all its subdomains where the path starts with
the rule's; the longest fitting rule decides, of equally long ones the first by text. Else the trees decide.

Features: length of URL and host, labels, depth, digit ratio, entropy of the host's characters, parameters, hyphens, longest run of
consonants, and suffix statistics: the smoothed share of unwanted URLs by top-level domain and by the last three
letters of the name before it, counted from the labelled URLs: of all suffixes, as literals up to ``LITERALS`` of them and as a joined table beyond. All are cut to small integers.

Training: logistic loss, ``TREES`` trees of depth ``DEPTH`` by Newton steps. A level is one aggregation of gradients
by (leaf, feature, bin), of which a table of fixed size comes back. The labelled URLs are given, or else those pages that a rule decides, at most about ``FIT_URLS`` of them,
picked by a hash of the URL: the trees carry on to other URLs what those have in common that the rules block. Without labelled URLs all others are allowed.
Scoring is one scan without a shuffle. Empty pages give no rows; repeated rows are judged alike, and train as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, hash_sample, small

#: (kind, host, path): fixed values of the task.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
TREES, DEPTH, RATE, DAMP = 10, 3, 0.5, 1.0
FIT_URLS = 20_000
#: Suffixes up to which their rates are literals of the expressions.
LITERALS = 500
BINS = 32


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its kind), both null if none fits. Rules are tried from the longest."""
    text = dot = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        dot = F.when(fits, F.lit(kind)) if dot is None else dot.when(fits, F.lit(kind))
    return text, dot


def _count(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]", ""))


def suffixes(host: Column) -> tuple[Column, Column]:
    """The top-level domain, and the end of the name's longest-but-last part: the last three letters before '.example.' or the domain."""
    labels = F.split(host, r"\.")
    names = F.filter(labels, lambda x: ~x.isin("www", "m", "blog", "example", "co"))
    name = F.when(F.size(names) > 1, F.element_at(F.slice(names, 1, F.size(names) - 1), -1)).otherwise(F.lit(""))
    return F.substring_index(host, ".", -1), F.right(name, F.lit(3))


def features(url: Column, host: Column, path: Column, rates: tuple[Column, Column]) -> dict[str, Column]:
    """Small integers, 0 to BINS - 1."""
    size = F.greatest(F.char_length(host), F.lit(1)).cast("double")
    chars = F.split(host, "")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, x: s - x * F.log2(x))
    query = F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?([^#]*)", 1)).otherwise(F.lit(""))
    runs = F.transform(F.split(host, "[^bcdfghjklmnpqrstvwxz]+"), lambda x: F.char_length(x))
    made = {
        "url_length": F.char_length(F.coalesce(url, F.lit(""))) / 8,
        "host_length": F.char_length(host) / 2,
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": _count(F.coalesce(url, F.lit("")), "0-9") * 64.0 / F.greatest(F.char_length(F.coalesce(url, F.lit(""))), F.lit(1)),
        "entropy": entropy * 6,
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda x: x != "")),
        "hyphens": _count(host, "-"),
        "consonants": F.array_max(runs),
        "domain_rate": rates[0] * (BINS - 1),
        "ending_rate": rates[1] * (BINS - 1),
    }
    return {k: F.coalesce(F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(BINS - 1)).cast("int"), F.lit(0)) for k, v in made.items()}


def labelled_by_rules(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """(url, unwanted) of the pages that a rule decides: a sample of about ``rows``, in which copies of a URL are all or none."""
    _, kind = rule_of(*host_path(F.col("url")))
    told = pages.select("url", (kind == "block").cast("int").alias("unwanted")).where("unwanted is not null")
    return hash_sample(told, "url", min(1.0, (rows or FIT_URLS) / max(1, told.count())), 19)


def suffix_rates(labelled: DataFrame) -> list[dict[str, float] | DataFrame]:
    """Shares of unwanted URLs by suffix, smoothed to one half, for each kind of suffix; a table (s, rate) if they are more than LITERALS."""
    host, _ = host_path(F.col("url"))
    out: list[dict[str, float] | DataFrame] = []
    for column in suffixes(host):
        counts = labelled.select(column.alias("s"), "unwanted").groupBy("s").agg(F.sum("unwanted").alias("bad"), F.count("*").alias("n"))
        rows = counts.limit(LITERALS + 1).collect()
        if len(rows) <= LITERALS:
            out.append({r.s: round((r.bad + 4) / (r.n + 8), 3) for r in rows})
        else:
            out.append(cut(counts.select("s", F.round((F.col("bad") + 4) / (F.col("n") + 8), 3).alias("rate")), "suffixes"))
    return out


def _rates(rows: DataFrame, host: Column, known: list[dict[str, float] | DataFrame]) -> tuple[DataFrame, tuple[Column, Column]]:
    """The rows, joined with the tables that are needed, and the columns of rates."""
    made = []
    for i, (column, rates) in enumerate(zip(suffixes(host), known, strict=True)):
        if isinstance(rates, DataFrame):
            rows = rows.join(small(rates.toDF(f"__s{i}", f"__rate{i}")), column == F.col(f"__s{i}"), "left")
            made.append(F.coalesce(F.col(f"__rate{i}"), F.lit(0.5)))
            continue
        table = F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv]) if rates else None
        made.append(F.coalesce(table[column], F.lit(0.5)) if rates else F.lit(0.5))
    return rows, (made[0], made[1])


class Trees:
    """Trees as lists of levels: leaf -> (feature, bin) and a value for each last leaf; a leaf's children are 2i and 2i + 1."""

    def __init__(self, bias: float, rates):
        self.bias, self.rates, self.trees = bias, rates, []

    @staticmethod
    def leaf(splits: dict[int, tuple[str, int]]) -> Column:
        """The number of the leaf that a row of feature columns comes to."""

        def go(i: int) -> Column:
            if i not in splits:
                return F.lit(i)
            f, b = splits[i]
            return F.when(F.col(f) > b, go(2 * i + 1)).otherwise(go(2 * i))

        return go(1)

    def margin(self) -> Column:
        def value(splits, leaves) -> Column:
            def go(i: int) -> Column:
                if i not in splits:
                    return F.lit(leaves.get(i, 0.0))
                f, b = splits[i]
                return F.when(F.col(f) > b, go(2 * i + 1)).otherwise(go(2 * i))

            return go(1)

        return reduce(lambda a, b: a + b, [value(*t) for t in self.trees], F.lit(self.bias))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Trees:
    import math

    host, path = host_path(F.col("url"))
    half = F.xxhash64("url", F.lit(1)) % 2 == 0
    known = suffix_rates(labelled.where(half))  # counted on one half, used as features on the other, so that trees see them as they will be
    labelled = labelled.where(~half)
    labelled, rates = _rates(labelled, host, known)
    made = features(F.col("url"), host, path, rates)
    rows = cut(labelled.select(F.col("unwanted").alias("y"), *[v.alias(k) for k, v in made.items()]).groupBy("y", *made).agg(F.count("*").alias("k")).coalesce(1), "urls")
    bad, n = rows.agg(F.sum(F.col("y") * F.col("k")), F.sum("k")).first()
    model = Trees(math.log(((bad or 0) + 1) / ((n or 0) - (bad or 0) + 1)), known)
    for _ in range(trees if n else 0):
        p = 1 / (1 + F.exp(-model.margin()))
        now = rows.select("*", ((p - F.col("y")) * F.col("k")).alias("g"), (p * (1 - p) * F.col("k")).alias("h"))
        splits: dict[int, tuple[str, int]] = {}
        leaves: dict[int, float] = {}
        for level in range(depth):
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in made]))
            sums = now.select(Trees.leaf(splits).alias("leaf"), "g", "h", cells.alias("x")).groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            grown = False
            for leaf in sorted({r.leaf for r in sums}):
                if leaf < 1 << level:
                    continue
                own = [r for r in sums if r.leaf == leaf]
                total_g, total_h = (sum(getattr(r, x) for r in own if r.f == own[0].f) for x in "gh")
                best = (1e-6, None)
                for f in made:
                    g = h = 0.0
                    for r in sorted((r for r in own if r.f == f), key=lambda r: r.b):
                        g, h = g + r.g, h + r.h
                        gain = g * g / (h + DAMP) + (total_g - g) ** 2 / (total_h - h + DAMP) - total_g**2 / (total_h + DAMP)
                        if total_h - h > 1e-9 and round(gain, 9) > best[0]:
                            best = (round(gain, 9), (f, r.b, g, h))
                leaves[leaf] = -RATE * total_g / (total_h + DAMP)
                if best[1]:
                    f, b, g, h = best[1]
                    splits[leaf], grown = (f, int(b)), True
                    leaves[2 * leaf], leaves[2 * leaf + 1] = -RATE * g / (h + DAMP), -RATE * (total_g - g) / (total_h - h + DAMP)
            if not grown:
                break
        model.trees.append((splits, leaves))
    drop_cut(rows)
    return model


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    model = fit(labelled_by_rules(pages) if labelled is None else labelled.select("url", F.col("unwanted").cast("int").alias("unwanted")).where("unwanted is not null"))
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows, rates = _rates(rows, F.col("host"), model.rates)
    made = features(F.col("url"), F.col("host"), F.col("path"), rates)
    rows = rows.select("page_id", "host", "path", *[v.alias(k) for k, v in made.items()])
    rule, kind = rule_of(F.col("host"), F.col("path"))
    by_trees = F.when(model.margin() > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(kind, by_trees).alias("verdict"))
