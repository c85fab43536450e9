import hashlib
import re
import time

from support import empty, table, texts

from tarnmill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c_d@e.f a@b@c.d x@y. @ a.b@c-d.e.f..g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.4444", "1.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 0000000000000 411111111111111 1", "+1 (830) 555-5433 +49 30 1234567 ++1 23 4 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +12",
    "é🙂 a@b.co 🙂1.2.3.4", "1" * 5000 + " x" + "a" * 20000 + "@", "a@b" + ".c" * 5000, "1 2" * 3000, "+" + "1(" * 5000, "1." * 5000, "a%b@x.y+z@w.v-",
]


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_base(text):
    found = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


def test_rules_equal_a_plain_model_and_stay(spark):
    rows = texts() + list(enumerate(ODD, 1000))
    got = pii.personal_data(table(spark, rows)).collect()
    assert len(got) == len(rows)
    columns = [f"n_{kind}" for kind in pii.KINDS]
    want = []
    for i, t in rows:
        spans = plain_base(t)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        want.append((i, *(sum(s[3] == kind for s in spans) for kind in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
        own = [r for r in got if r["doc_id"] == i and r["base_sha256"] == want[-1][-1]]
        assert own and set(filter(None, joined.split(","))) <= set(own[0]["spans"].split(","))
    assert sorted(((r["doc_id"], *(r[c] for c in columns), r["base_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    assert pii.personal_data(empty(spark)).count() == 0


def test_credentials_are_added_and_words_are_not(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda1"
    rows = [(k, f'some text token = "{key}" more, call (555) 234-567{k % 10} or write a.b{k}@mail.example.com') for k in range(30)]
    rows += [(100 + k, "plain words without anythingtosee, and chapter averylongidentifier2 follows") for k in range(30)]
    got = {r["doc_id"]: r for r in pii.personal_data(table(spark, rows)).collect()}
    text = dict(rows)
    for i, r in got.items():
        spans = {s.split(":")[0]: text[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s}
        if i < 100:
            assert spans["secret"] == key and spans["number"].startswith("(555)") and spans["email"] == f"a.b{i}@mail.example.com"
        else:
            assert spans == {} and r["n_added"] == 0


def test_many_matches_in_one_text_end_soon(spark):
    n = 200_000
    rows = [(1, "12, " * n), (2, "1.2.3.4 " * 50_000), (3, "x@y.z " * 130)]
    started = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(table(spark, rows)).collect()}
    assert time.time() - started < 90
    assert got[1]["spans"] == "" and got[2]["n_ip"] == 50_000 and got[3]["n_email"] == 130
    assert got[2]["spans"].split(",")[-1] == f"ip:{8 * 49_999}:{8 * 49_999 + 7}"
    assert got[3]["spans"].split(",")[64:66] == ["email:384:389", "email:390:395"]


def test_a_digit_behind_many_letters(spark):
    key = "ghp_" + "aB" * 30 + "9x8y7z6w5v4u3t"
    rows = [(k, f"the token is {key}{k} here") for k in range(40)] + [(100 + k, "plain words " * 5) for k in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(table(spark, rows)).collect()}
    assert got[7] == f"secret:13:{13 + len(key) + 1}"


def test_main_path_has_no_python(spark):
    plan = pii.personal_data(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
