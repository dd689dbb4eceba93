import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm.exact import exact_dedup, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")].append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            out.append((r["doc_id"], best["doc_id"], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_groups(edge, support):
    rows = edge.collect()
    got = exact_groups(edge, support).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})


def test_rows_keep_all_columns(edge):
    out = exact_dedup(edge)
    assert out.columns == edge.columns
    ids = sorted(r["doc_id"] or 0 for r in out.collect())
    assert ids == [0, 3, 4, 7, 8, 9, 10, 11, 12]


def test_empty_table(nothing):
    assert exact_groups(nothing).count() == 0 and exact_dedup(nothing).count() == 0
