"""URL judgement by rules and, where no rule fits, by a path-template tree learned from the rules' verdicts or other labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up

#: A node whose children are at least so many, and so many of which its URLs have on average one, varies: they become `*`.
VARIABLE_CHILDREN, VARIABLE_SHARE = 8, 0.5
#: Branches merge if their children are spread as their siblings' are, up to this total variation distance, and their labels differ by less than so many standard errors.
MERGE_DISTANCE, MERGE_Z = 0.2, 2.0
#: Labels that the share of blocked ones above a node is worth in the node's own, the smoothed share from which a template is rejected, and the labels its host needs.
PRIOR_WEIGHT, REJECT_PURITY, LEAST_LABELS = 2.0, 0.8, 3
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, line: str) -> "Rule":
        verdict, _, where = line.partition(" ")
        host, slash, path = where.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. Of equally long ones the first in the list wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """A path's segments, empty ones left out, with numbers and long hexadecimal ids as marks."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, "(?i)[0-9a-f]{8}(?:-?[0-9a-f]{4}){2,}[0-9a-f-]*", "{x}"), "[0-9]+", "{n}"))


def _node_above(shared: str) -> Column:
    """The first `shared` segments of `rest` as the end of a template."""
    parts = F.slice("rest", F.lit(1), F.col(shared))
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise("")


def learn_templates(urls: DataFrame) -> DataFrame:
    """(host, shape, n, template, purity, labelled, bad, host_labelled, rejected) of every shape of `urls` (host, shape, bad: 1, 0 or null), which n URLs have.

    The tree is grown for all hosts at once, over counts of shapes, not over URLs; a node is a (host,
    template so far), and its shapes differ in the `rest` of their segments. In a round each open node first goes down the
    segments that all its shapes share; of the children that follow, those that vary too much become `*`, and of the others
    those that are like their siblings pooled become one branch `~`. A node with one `rest` ends at once, however deep
    that is, so rounds follow the branching of paths. A hot host is summed up before any shuffle, and nothing compares pairs.

    A node's purity is its share of blocked labels, smoothed toward that of the node above it, and the host's
    toward that of all: a branch without labels is judged by the nearest evidence above it. A template is rejected from
    REJECT_PURITY on, on hosts with LEAST_LABELS labels.
    """
    counts = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    smoothed = (F.coalesce(F.sum("bad"), F.lit(0)) + PRIOR_WEIGHT * F.first("above")) / (F.coalesce(F.sum("labelled"), F.lit(0)) + PRIOR_WEIGHT)
    keys = ["host", "template"]
    shapes = cut(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")))
    total = shapes.agg(F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).first()[0] or 0.0
    open_ = shapes.select("*", F.lit("").alias("template"), F.col("shape").alias("rest"), F.lit(total).alias("above"))
    ended = []
    while True:
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False).cast("int")
        nodes = open_.groupBy(*keys).agg(F.min("rest").alias("low"), F.max("rest").alias("high"), smoothed.alias("purity"))
        nodes = nodes.select(*keys, "purity", F.when(differ == 0, F.size("low")).otherwise(differ - 1).alias("shared"))
        at = open_.join(nodes, keys).withColumn("template", F.concat("template", _node_above("shared")))
        at = cut(at.withColumn("rest", F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest"), F.lit(1)))).drop("shared", "above"))
        ended.append(at.where("size(rest) = 0").drop("rest"))
        here = at.where("size(rest) > 0").withColumn("child", F.element_at("rest", 1))
        if here.isEmpty():
            break
        after = F.coalesce(F.try_element_at("rest", F.lit(2)), F.lit("/"))
        spread = here.groupBy(*keys, "child", after.alias("after")).agg(*counts)
        branches = spread.groupBy(*keys, "child").agg(*counts)
        node = branches.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
            F.sum((F.col("labelled") > 0).cast("int")).alias("labelled_children"),
        )
        pooled = spread.groupBy(*keys, "after").agg(F.sum("n").alias("pooled_n"))
        own = branches.select(*keys, "child", F.col("n").alias("own_n"), F.col("labelled").alias("own_labelled"), F.col("bad").alias("own_bad"))
        compared = spread.join(pooled, [*keys, "after"]).join(own, [*keys, "child"]).join(node, keys)
        p, q = F.col("n") / F.col("own_n"), F.col("pooled_n") / F.col("all_n")
        first = [F.first(c).alias(c) for c in ("own_n", "own_labelled", "own_bad", "children", "all_n", "all_labelled", "all_bad", "labelled_children")]
        judged = compared.groupBy(*keys, "child").agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("distance"), *first)
        rest, rate = F.col("all_labelled") - F.col("own_labelled"), F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(rate * (1 - rate) * (1 / F.col("own_labelled") + 1 / rest))
        gap = F.abs(F.col("own_bad") / F.col("own_labelled") - (F.col("all_bad") - F.col("own_bad")) / rest)
        labels_agree = F.when(F.col("own_labelled") == 0, (F.col("labelled_children") != 1)).when(rest == 0, False).otherwise(gap <= MERGE_Z * error)
        variable = (F.col("children") >= VARIABLE_CHILDREN) & (F.col("children") >= VARIABLE_SHARE * F.col("all_n"))
        alike = (F.col("children") > 1) & (F.col("distance") <= MERGE_DISTANCE + 1e-9) & labels_agree
        step = judged.select(*keys, "child", F.when(variable, "*").when(alike, "~").otherwise(F.col("child")).alias("step"))
        named = here.join(step, [*keys, "child"]).withColumn("template", F.concat("template", F.lit("/"), "step"))
        open_ = cut(named.withColumn("rest", F.slice("rest", 2, F.size("rest"))).withColumnRenamed("purity", "above").drop("child", "step"))
    of_host = shapes.groupBy("host").agg(F.sum("labelled").alias("host_labelled"))
    found = reduce(DataFrame.unionByName, ended).join(of_host, "host")
    return cut(found.select("host", "shape", "n", "template", "purity", "labelled", "bad", "host_labelled", ((F.col("purity") >= REJECT_PURITY) & (F.col("host_labelled") >= LEAST_LABELS)).alias("rejected")))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host: whoever shares them is taken for one owner."""
    return F.regexp_extract(host, "[^.]*\\.?[^.]*$", 0)


def scoped_templates(urls: DataFrame) -> DataFrame:
    """(host, shape, n, template, purity, rejected) of every host's shapes (host, shape, bad), with evidence from other hosts.

    Trees are grown for each host, for each registered domain and for all hosts, in the same rounds. What the template of a shape has of labels
    counts in that order: the host's own; smoothed toward that, the domain's template of the shape; toward that, the one of all hosts; and that toward the purity
    that the host's tree gives it, which is the evidence above: the node, the host, all labels. So a path is judged by the same
    path elsewhere before its host is asked. It's rejected from REJECT_PURITY on, where its host or its template among all hosts has LEAST_LABELS labels.
    """
    host = F.col("host")
    keys = F.array(F.concat(F.lit("host "), host), F.concat(F.lit("domain "), registered_domain(host)), F.lit("all"))
    found = learn_templates(urls.select(F.explode(keys).alias("host"), "shape", "bad"))
    sums = found.groupBy("host", "template").agg(F.sum("labelled").alias("labels"), F.sum("bad").alias("bads"))
    found = found.join(sums, ["host", "template"])
    own = found.where("host LIKE 'host %'").select(F.substr("host", F.lit(6)).alias("host"), "shape", "n", "template", "purity", "host_labelled", "labels", "bads")
    of_domain = found.where("host LIKE 'domain %'").select(F.substr("host", F.lit(8)).alias("domain"), "shape", F.col("labels").alias("domain_labels"), F.col("bads").alias("domain_bads"))
    of_all = found.where("host = 'all'").select("shape", F.col("labels").alias("all_labels"), F.col("bads").alias("all_bads"))
    met = own.withColumn("domain", registered_domain(host)).join(of_domain, ["domain", "shape"]).join(of_all, "shape")
    purity = F.col("purity")
    for labels, bads in (("all_labels", "all_bads"), ("domain_labels", "domain_bads"), ("labels", "bads")):
        purity = (F.col(bads) + PRIOR_WEIGHT * purity) / (F.col(labels) + PRIOR_WEIGHT)
    known = F.greatest("host_labelled", "all_labels") >= LEAST_LABELS
    return cut(met.select("host", "shape", "n", "template", purity.alias("purity"), ((purity >= REJECT_PURITY) & known).alias("rejected")))


def judge_urls(pages: DataFrame, rules: list[Rule], labels: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page's URL.

    `labels` (1 bad, 0 good, null unknown) trains the templates; without it the rules' own
    verdicts do. A URL without a fitting rule is blocked if its template is rejected. Null URLs and
    those without `://` have an empty host and path; they are judged like any other. Rows that
    repeat are judged each; an empty table gives an empty one; other columns aren't read.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if labels is None else labels).alias("bad"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = urls.withColumn("rule", name).withColumn("ruled", verdict).withColumn("shape", shape_of(F.col("path")))
    if labels is None:
        ruled = ruled.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    templates = scoped_templates(ruled.select("host", "shape", "bad"))
    judged = looked_up(ruled, templates, ["host", "shape"], "n")
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
