"""The registered rolling merge against a plain fold."""

from itertools import groupby

from foliant.plans import registry
from foliant.plans.oracles import MERGE_CAP

SF = "/root/testdata/sf0.001"


def merged(totals, candidates, cap):
    """A dict in order of entry; beyond the cap the heaviest stay, of equal ones the earliest."""
    for term, weight in candidates:
        totals[term] = totals.get(term, 0.0) + weight
    if len(totals) <= cap:
        return totals
    return dict(sorted(totals.items(), key=lambda x: -x[1])[:cap])


def test_the_merge_of_the_query_equals_a_plain_fold(spark):
    rows = registry._candidates(spark, SF, 3).collect()
    rows.sort(key=lambda r: (r["book_id"], r["sort_order"], r["segment_no"], r["rank"]))
    want = set()
    for book, chapters in groupby(rows, key=lambda r: r["book_id"]):
        book_totals = {}
        for _, segments in groupby(chapters, key=lambda r: r["sort_order"]):
            chapter = {}
            for _, part in groupby(segments, key=lambda r: r["segment_no"]):
                chapter = merged(chapter, [(r["term"], r["weight"]) for r in part], MERGE_CAP)
            book_totals = merged(book_totals, list(chapter.items()), MERGE_CAP)
        want |= {(book, n, term, w) for n, (term, w) in enumerate(book_totals.items(), 1)}
    got = registry.queries()["keywords_merge_topk"](spark, SF).collect()
    assert {(r["book_id"], r["rank"], r["term"], r["weight"]) for r in got} == want and len(want) == len(got) > 100
