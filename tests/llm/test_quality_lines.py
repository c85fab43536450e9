import collections
import hashlib
import re

from support import empty, table, texts

from tarnmill.llm import lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words, width):
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    counts = collections.Counter(windows)
    return sorted({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(width)})


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = sum(map(len, WORD.findall(line)))
        if own and line in seen:
            dup, dup_chars = dup + 1, dup_chars + own
        seen.add(line)
    n_repeat = len(repeated(words, 8))
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    kept = not failed and 100 * dup_chars <= quality.LINE_LIMIT * chars
    for width, limit in quality.LIMITS.items():
        kept = kept and 100 * sum(len(words[i]) for i in repeated(words, width)) <= limit * chars
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, n_repeat, failed, kept


def test_quality_equals_a_plain_model(spark):
    got = quality.quality(table(spark)).collect()
    want = sorted(((i, *plain_quality(t)) for i, t in texts()), key=repr)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == want
    assert quality.quality(empty(spark)).count() == 0


def test_kept_documents_keep_all_columns(spark):
    docs = table(spark)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i, t in texts() if plain_quality(t)[-1])


def plain_lines(rows, least):
    strip = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(strip))

    docs = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if not (key(x) and docs[key(x)] >= least)]
        out.append((i, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def hashed(df):
    return sorted(((r["doc_id"], r["total"], r["gone"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()), key=repr)


def test_line_dedup_equals_a_plain_model(spark, monkeypatch):
    for least in (2, 10):
        got = lines.drop_repeated_lines(table(spark).repartition(3), least, "total", "gone")
        assert hashed(got) == plain_lines(texts(), least)
    assert lines.drop_repeated_lines(empty(spark), 2, "total", "gone").count() == 0
    # beyond the size that is sent to every task
    monkeypatch.setattr(lines, "SMALL_ROWS", 0)
    assert hashed(lines.drop_repeated_lines(table(spark), 2, "total", "gone")) == plain_lines(texts(), 2)


def test_line_dedup_is_exact_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(lines, "FILTER_BITS", 1 << 11)
    monkeypatch.setattr(lines, "SLICE_BITS", (1 << 11) // lines.SLICES)
    assert hashed(lines.drop_repeated_lines(table(spark).repartition(4), 10, "total", "gone")) == plain_lines(texts(), 10)


def test_first_documents(spark):
    rows = [(3, "a\nb"), (1, "b\nc"), (2, "A ")]
    firsts = lines.first_documents(table(spark, rows)).collect()
    assert {bytes(r["key"]): r["doc_id"] for r in firsts} == {lines.digest(b"a"): 2, lines.digest(b"b"): 1}
