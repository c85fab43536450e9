import hashlib
import zlib

from support import empty, table, texts

from tarnmill.llm import sharding, urls


def plain_shards(rows, shards=24):
    full = []
    for i, t in rows:
        raw = (t or "").encode()
        full.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(1 << 63) if i is None else i, i, len(raw) + 8, zlib.crc32(raw)))
    full.sort(key=lambda r: r[:2])
    total = sum(r[3] for r in full)
    group, first, at = {}, {}, 0
    for r in full:
        group[r[0]] = group.get(r[0], 0) + r[3]
        first.setdefault(r[0], at)
        at += r[3]
    out, slots, at = [], {}, 0
    for r in full:
        begin = first[r[0]] if 100 * shards * group[r[0]] <= total else at
        shard = shards * begin // total
        out.append((r[2], r[3], r[4], shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += r[3]
    return out


def test_shards_equal_a_plain_model(spark):
    rows = [(k, f"text {k}" * (k % 7)) for k in range(300)] + [(1000 + k, "a hot text of many copies") for k in range(150)]
    got = sharding.shard(table(spark, rows).repartition(4)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(plain_shards(rows))


def test_odd_rows_and_balance(spark):
    rows = texts() + [(7, "one row many times")] * 400
    got = sharding.shard(table(spark, rows)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["text_crc32"])
    assert sorted(map(key, got)) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own))) and 0 <= shard < 24
    assert sharding.shard(empty(spark)).count() == 0
    sizes = [0] * 24
    for r in sharding.shard(table(spark, [(7, "one row many times")] * 480)).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes) - min(sizes) <= 26


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path


URLS = [
    None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/2", "https://notexample.org/en/1", "https://org",
    "https://x.com/fr/a", "https://x.com/de/a", "https://y.com/en/a", "ftp://É.com?q=/de/", "a://b://c/d", "http://h#f/de/", "http://[::1]:80/de/" + "x" * 50000,
]


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "https://x.com/de/a")] * 3
    pages = spark.createDataFrame([(i, u, "k", 1, "r") for i, u in rows], "page_id long, url string, host string, n long, rule string")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        assert (by_id[i]["host"], by_id[i]["path"]) == (host, path)
        fits = [(h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, action = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert by_id[i]["rule"] == rule and (action is None or by_id[i]["verdict"] == action)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_reputation_spreads_from_host_to_domain(spark):
    rows = [f"https://a.bad.com/de/{k}" for k in range(60)] + [f"https://good{k}.com/fr/{k}" for k in range(60)]
    rows += ["https://a.bad.com/en/1", "https://b.bad.com/en/1", "https://good3.com/en/1", "https://new.com/en/1", "https://other.net/x"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["host"]: r["verdict"] for r in urls.filter_urls(pages).collect() if r["rule"] is None}
    assert got == {"a.bad.com": "block", "b.bad.com": "block", "good3.com": "allow", "new.com": "allow", "other.net": "allow"}


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.example.com", "com", "", "a.b.c:8080"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = urls.suffix_and_domain(df["host"])
    assert [tuple(r) for r in df.select(suffix, domain).collect()] == [
        ("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("com", "example.com"), ("com", "com"), ("", ""), ("c", "b.c"),
    ]
