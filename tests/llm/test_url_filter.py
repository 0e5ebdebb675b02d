import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import url_filter as U
from tidemill.llm.kernels import flat

GLOB = st.text(alphabet="ab*?/é", max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(GLOB, min_size=1, max_size=12), st.lists(st.text(alphabet="ab/é日", max_size=9), min_size=1, max_size=6))
def test_same_as_regular_expressions(globs, urls):
    hits = U.Automaton(globs).match(*flat(pa.array(urls)))
    want = [[re.fullmatch(U._regex(g).replace("(?s)", ""), u, re.S) is not None for g in globs] for u in urls]
    assert hits.tolist() == want


def test_rules_longer_than_a_word_carry_over():
    long = "*" + "ab" * 100 + "?c*"
    urls = ["x" + "ab" * 100 + "zc", "ab" * 100 + "c", "ab" * 101 + "c", ""]
    hits = U.Automaton(["a", long, "*"]).match(*flat(pa.array(urls)))
    assert hits[:, 1].tolist() == [True, False, False, False] and hits[:, 2].all()
    assert U.Automaton(["*" + "ab" * 70 + "*"]).match(*flat(pa.array(["ab" * 5000])))[0, 0]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "HTTP://WWW.Free-Bets.com:80/A/?utm_source=x&p=1#f"), (3, "https://a.edu/login"), (None, "https://x.org/" + "y" * 9000 + ".exe")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as rules", "2 as canonical_url")
    got = {(r.page_id, r.url): r for r in U.filter_urls(df).collect()}
    assert len(got) == 5
    assert got[1, None].canonical_url is None and not got[1, None].blocked and got[1, None].rules == ""
    assert got[2, ""].n_rules == 0
    assert got[rows[2]].canonical_url == "http://free-bets.com/A/?p=1" and got[rows[2]].rules == "bets" and got[rows[2]].blocked
    assert got[rows[3]].rules == "edu,login" and not got[rows[3]].blocked
    assert got[rows[4]].blocked
    assert U.filter_urls(df.limit(0)).count() == 0


def test_escapes():
    assert U.Automaton(["a\\*b", "a\\?"]).match(*flat(pa.array(["a*b", "axb", "a?"]))).tolist() == [[True, False], [False, False], [False, True]]
    assert np.array_equal(U.Automaton([""]).match(*flat(pa.array(["", "a"])))[:, 0], [True, False])
