"""Import rules as a table, against every rule tried on every address."""

import itertools
import re

from recordloom.operators.rules import RULES, apply_rules, matching_rules

URLS = [
    "https://a.example.org/x/y", "https://EXAMPLE.org/x", "http://u:p@b.a.example.org:80/x?y=1", "https://example.org.evil.com/x",
    "https://notexample.org/x", "https://host", "https://host?x=/a", "drs://a.b/", "nothing", "", None, "https://./", "https://a..b/x",
]
TABLE = [
    ("1", "example.org", "", None, True, None, ["g"]), ("2", "example.org", "/x", r"/y$", None, True, ["g", "a"]), ("3", "a.example.org", "/x/", None, False, False, []),
    ("4", "", "/a", None, None, None, None), ("5", None, None, r"^drs:", False, False, ["z", None]), ("6", "HOST", "", None, False, False, ["h"]),
    ("7", "org", "", None, False, False, ["g"]),
]


def fits(rule, url):
    _, host, path, pattern, *_ = rule
    host, path = (host or "").lower(), path or ""
    found = re.match(r"[^:/?#]+://(?:[^/?#@]*@)?([^:/?#]*)", url)
    own = found.group(1).lower() if found else ""
    rest = re.match(r"[^:/?#]+://[^/?#]*([^?#]*)", url)
    where = rest.group(1) if rest else ""
    return (not host or own == host or own.endswith("." + host)) and where.startswith(path) and (pattern is None or re.search(pattern, url) is not None)


def test_rules_fit_as_if_each_was_tried(spark):
    requests = spark.createDataFrame(list(enumerate(URLS)), "request_id long, url string")
    rules = spark.createDataFrame(TABLE, RULES)
    want = {(i, r[0]) for (i, u), r in itertools.product(enumerate(URLS), TABLE) if u is not None and fits(r, u)}
    assert {(r.request_id, r.rule_id) for r in matching_rules(requests, rules).collect()} == want
    got = {r.request_id: r for r in apply_rules(requests, rules).collect()}
    assert len(got) == len(URLS)
    for i in range(len(URLS)):
        mine = [r for r in TABLE if (i, r[0]) in want]
        assert (got[i].rules, got[i].allowed) == (len(mine), bool(mine))
        assert (got[i].private, got[i].protected) == (any(r[4] for r in mine), any(r[5] for r in mine))
        assert got[i].groups == sorted({g for r in mine for g in r[6] or [] if g})
    assert apply_rules(requests, rules.limit(0)).where("allowed").count() == 0
    assert apply_rules(requests.limit(0), rules).collect() == []


def test_rules_meet_requests_by_an_equi_join(spark, sf):
    from recordloom.plans.registry import load

    found = load()[0]["import_rules_table"](spark, sf)
    tree = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in tree and "Cartesian" not in tree
