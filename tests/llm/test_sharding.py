import json
from collections import defaultdict

from daygrid.llm.sharding import assign, write_shards


def test_every_shard_fits_and_buckets_are_minimal(make):
    rows = [(i, "word " * (i % 40)) for i in range(400)] + [(1000, None), (1001, "big " * 2000)]
    out = assign(make(rows), 1000).collect()
    assert len(out) == len(rows)
    sizes, rows_in = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["shard"], r["page"]] += r["n_bytes"]
        rows_in[r["shard"], r["page"]] += 1
        assert len(r["shard"]) == r["depth"]
    assert all(s <= 1000 or rows_in[k] == 1 for k, s in sizes.items())
    prefixes = defaultdict(int)
    for (shard, _), s in sizes.items():
        for d in range(len(shard)):
            prefixes[shard[:d]] += s
    assert all(s > 1000 for s in prefixes.values())  # only buckets above the limit were split


def test_repeated_rows_go_to_pages(make):
    out = assign(make([(1, "x" * 100)] * 57 + [(2, "y")]), 1000).collect()
    pages = defaultdict(int)
    for r in out:
        if r["doc_id"] == 1:
            pages[r["page"]] += r["n_bytes"]
    assert len(out) == 58 and sorted(pages.values()) == [700, 1000, 1000, 1000, 1000, 1000]


def test_files_lose_no_row(make, tmp_path):
    rows = [(None, "x" * 90), (None, "y"), (1, "x" * 90), (1, "x" * 90), (1, None), (2, "z" * 40)] + [(7, "same " * 20)] * 130
    write_shards(make(rows), str(tmp_path / "s"), 1000)
    files = defaultdict(list)
    for p in (tmp_path / "s").rglob("*.json"):
        files[p.parent] += [json.loads(x) for x in p.read_text().splitlines()]
    found = [(r.get("doc_id"), r.get("text")) for lines in files.values() for r in lines]
    assert sorted(found, key=str) == sorted(rows, key=str)
    assert all(sum(len(r.get("text") or "") for r in lines) <= 1000 for lines in files.values())


def test_edges_and_files(make, edge_docs, no_docs, tmp_path):
    assert assign(edge_docs, 500).count() == 11
    assert assign(no_docs, 500).count() == 0
    docs = make([(i, f"text {i} " * 20) for i in range(50)])
    write_shards(docs, str(tmp_path / "s"), 900)
    found = [json.loads(x) for p in (tmp_path / "s").rglob("*.json") for x in p.read_text().splitlines()]
    assert sorted(r["doc_id"] for r in found) == list(range(50)) and {r["component"] for r in found} == {"kept"}
