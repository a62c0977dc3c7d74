"""BibTeX, element trees, segments and tokens against plain readers."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import bibliography, elements, segments
from lakeloom.operators.segments import Delimiter, Rule
from lakeloom.plans.catalogue import CATALOGUE


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [(r.id, r.entry_type, r.citation_key, r.tags) for r in bibliography.entries(df, "id", "t").orderBy("id", "ord").collect()]


@pytest.mark.parametrize(("text", "tags"), [
    (r"@a{k, note = {x \} y}, t = {z}}", {"note": r"x \} y", "t": "z"}), ('@a{k, title = "a } b", t = {z}}', {"title": "a } b", "t": "z"}), ('@a{k, month = jan # "1" # {2}}', {"month": "jan12"}), ("@a{k, month = FEB, year = 2001 , }", {"month": "feb", "year": "2001"}),
    ("@a{k, % c, x = 1 }\n t % more\n = % and\n {a % b}}", {"t": "a % b"}), (r'@a{k, t = "say \"hi\" {"}', {"t": r"say \"hi\" {"}), ("@a{k, T = {a}, t = {b\n  c}}", {"t": "b c"}), ("@a{k}", {}), ("@a{k,}", {}), ("x @ y @a {k , t={{{}}}}", {"t": "{{}}"}), (r"@a{k, t = {\\}}", {"t": r"\\"}), ("@A\n{k:1/2, a-b.c = 5}", {"a-b.c": "5"}),
])
def test_bibtex_values(spark, text, tags):
    (row,) = parsed(spark, text)
    assert row[1] == "a" and row[3] == tags


def test_bibtex_broken_entries_lose_no_other(spark):
    text = "@a{one, t = {x}} @a{open, t = {y} @a{no equals} @comment{ {x} @a{hidden, t={h}} } @string{s = {q}} @b{two, t = 1} @c{three, t = {unclosed"
    assert [(r[1], r[2]) for r in parsed(spark, text)] == [("a", "one"), ("b", "two")]
    assert parsed(spark, None, "", "no entries", "@", "@a", "@a{", "%@a{k}\n") == [(6, "a", "k", {})]


def plain_value(text, i):
    """One character at a time, as a reader of a single value would."""
    close, depth, out, i = ("}" if text[i] == "{" else '"'), 0, [], i + 1
    while True:
        c = text[i]
        if c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == close and (close == '"' or not depth):
            return "".join(out), i + 1
        if close == "}":
            depth += (c == "{") - (c == "}")
        out.append(c)
        i += 1


def test_bibtex_generated(spark):
    rng = random.Random(4)
    texts, want = [], []
    for n in range(60):
        text, entries = "", []
        for k in range(rng.randrange(4)):
            text += rng.choice(["", " noise % } { \n", "@comment{a {b} \\} c}\n"]) + f"@t{{k{k}"
            tags = {}
            for j in range(rng.randrange(5)):
                parts = []
                for _ in range(rng.randrange(1, 4)):
                    inner = "".join(rng.choice(["a", "\\{", "\\}", '\\"', "\\\\", "%", "#", ",", "=", "@", "é"]) for _ in range(rng.randrange(6)))
                    parts.append(rng.choice([f'"{inner}}}{{{{"', f"{{{inner}}}", f"{{{inner}{{{inner}}}}}", "{{}}", "12", "may"]))
                text += f", f{j} = " + rng.choice([" # ", "#", "\n#% c\n "]).join(parts)
                tags[f"f{j}"] = re.sub(r"\s+", " ", "".join(plain_value(p, 0)[0] if p[0] in '{"' else p for p in parts)).strip()
            text += rng.choice(["", ",", " , % x\n"]) + "}\n"
            entries.append((n, "t", f"k{k}", tags))
        texts.append(text)
        want += entries
    assert parsed(spark, *texts) == want


PAGES = [
    '<html><body class="a"><ul><li>one<li class="x y">two <b>b</b></ul><p>p1<p>p2 <i>i<div id=d>d<br><img src=1>e</div></i></p></body></html>',
    "<table><tr><td>1<td>2<tr><td><p>x<table><tr><td>y</table></table></b><!-- <p> --><script>var a = '<p>';</script>",
    "", None, "text only", "<p>" * 30 + "</div>", "<div>" * 200, '<a href="1" HREF="2">x</a><A>y',
]


def test_elements_against_walks(spark):
    df = elements.elements(spark.createDataFrame(list(enumerate(PAGES)), "id int, h string").repartition(3), "id", "h").cache()
    rows = {}
    for r in df.collect():
        rows.setdefault(r.id, {})[r.pre] = r
    assert set(rows) == {0, 1, 5, 6, 7} and [r.tag for r in rows[0].values()] == "html body ul li li b p p i div br img".split()
    assert rows[7][0].attrs == {"href": "1"} and [rows[5][i].parent for i in range(30)] == [None] * 30 and rows[6][199].depth == 199
    assert [(r.tag, r.parent) for r in rows[1].values()][:9] == [("table", None), ("tr", 0), ("td", 1), ("td", 1), ("tr", 0), ("td", 4), ("p", 5), ("table", 5), ("tr", 7)]

    def above(page, r):
        while r.parent is not None:
            r = page[r.parent]
            yield r

    for page in rows.values():
        for r in page.values():
            assert {a.pre for a in above(page, r)} == {a.pre for a in page.values() if a.pre < r.pre < a.stop}
    hit = F.col("tag").isin("div", "ul", "td", "p", "a") & (F.col("pre") % 3 < 2)
    match = lambda r: r.tag in ("div", "ul", "td", "p", "a") and r.pre % 3 < 2
    every = [(i, page, r) for i, page in rows.items() for r in page.values()]
    got = sorted(tuple(r) for r in elements.parents(df, "id", hit).collect())
    assert got == sorted((i, r.pre, a.pre, n) for i, page, r in every for n, a in enumerate((a for a in above(page, r) if match(a)), 1))
    near = sorted(tuple(r) for r in elements.closest(df, "id", hit).collect())
    assert near == sorted((i, r.pre, c.pre) for i, page, r in every if (c := next((a for a in [r, *above(page, r)] if match(a)), None)))
    kids = sorted(tuple(r) for r in elements.children(df, "id", F.col("tag").isin("body", "tr", "div"), hit).collect())
    assert kids == sorted((i, r.parent, r.pre) for i, page, r in every if r.parent is not None and page[r.parent].tag in ("body", "tr", "div") and match(r))
    beside = {(r.id, r.pre): (r.prev, r.next) for r in elements.siblings(df, "id", hit).collect()}
    for i, page, r in every:
        same = [x.pre for x in page.values() if x.parent == r.parent and match(x)]
        assert beside[i, r.pre] == (max((x for x in same if x < r.pre), default=None), min((x for x in same if x > r.pre), default=None))
    clicks = spark.createDataFrame([(9, 0, 5), (8, 0, 0), (7, 6, 150), (6, 99, 1)], "event int, id int, target int")
    assert sorted((r.event, r.handler) for r in elements.delegated(clicks, df, "id", "target", F.col("tag").isin("ul", "div")).collect()) == [(7, 150), (9, 2)]
    assert df.filter(elements.has_class("y")).select("id", "pre").collect() == [(0, 4)] and df.filter(elements.attribute("id") == "d").count() == 1


def test_handlers_of_all_pages_and_elements(spark, tmp_path):
    html = "<html><body><nav><ul><li><a>1</a></li></ul></nav>{}</body></html>"
    pages = [(3 * i - 30, html.format("<p>x</p>" * (i % 7 + 40 * (i % 50 == 0)))) for i in range(150)] + [(1000, ""), (1001, None)]
    clicks = [(i - 100, i // 150 - 3) for i in range(150 * 60)] + [(None, 1), (9999, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(clicks, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    run, sql = CATALOGUE["delegated_handlers"]
    got = run(spark, str(tmp_path)).select("user_id", "page_id", "handler", "event_id").collect()
    assert {(r.page_id, r.handler) for r in got} == {(k, n) for k, h in pages[:150] for n in (4, 5, *range(6, 6 + h.count("<p>")))}
    want = {}
    for event, user in clicks[:-2]:
        k, h = pages[event % 150]
        at = user % (6 + h.count("<p>"))
        if at > 3:
            want[user, k, at] = min(event, want.get((user, k, at), event))
    assert {tuple(r)[:3]: r.event_id for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    for name in ("pages", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select user_id, page_id, handler, event_id from ({sql})").fetchall())
    spark.createDataFrame([], "page_id long, html string").write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    assert run(spark, str(tmp_path)).count() == 0


def plain_cut(text, delimiters):
    parts = [("text", text, text, False)] if text else []
    for left, right, display in delimiters:
        done = []
        for kind, data, raw, shown in parts:
            if kind != "text":
                done.append((kind, data, raw, shown))
                continue
            begin = i = 0
            while i < len(data):
                if not data.startswith(left, i):
                    i += 1
                    continue
                done += [("text", data[begin:i], data[begin:i], False)] if i > begin else []
                begin, j, depth = i, i + len(left), 0
                while j < len(data) and not (depth <= 0 and data.startswith(right, j)):
                    depth += (data[j] == "{") - (data[j] == "}")
                    j += 2 if data[j] == "\\" else 1
                if j >= len(data):
                    break
                done.append(("math", data[i + len(left) : j], data[i : j + len(right)], display))
                begin = i = j + len(right)
            done += [("text", data[begin:], data[begin:], False)] if begin < len(data) else []
        parts = done
    return parts


DELIMITERS = (Delimiter("$$", "$$", True), Delimiter("\\(", "\\)"), Delimiter("$", "$"), Delimiter("[[", "]]"))


def test_segments_against_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["$", "$$", "\\(", "\\)", "{", "}", "\\", "a", " b ", "[[", "]]", "é"]) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["", None, "plain", "a $x$ b", "$a{$}b$", r"$a\$b$ c", "$$$$", "{$}$", "$" * 2001, "x " * 50_000 + "$y$"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = {}
    for r in segments.segments(df, "id", "t", DELIMITERS).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.kind, r.data, r.raw, r.display))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_cut(t or "", [(d.left, d.right, d.display) for d in DELIMITERS]), t
        assert "".join(p[2] for p in got.get(i, [])) == (t or "")


RULES = (Rule("comment", r"#.*", greedy=True), Rule("string", r"'[^'\n]*'", greedy=True), Rule("key", r"(^|\s)\w+(?==)", behind=True), Rule("number", r"\d+"), Rule("call", r"\w+\([^()]*\)", inside=(Rule("name", r"^\w+"), Rule("mark", r"[(),]"))))


def spans(spark, texts, rules):
    got = {}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for r in segments.tokens(df, "id", "t", rules).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.kind, r.start, r.stop, r.depth))
    return got


def test_tokens(spark):
    got = spans(spark, ["a='x # y' # it's\nb=12 f(1,x)", "f(z,q) 'a", None, ""], RULES)
    text = "a='x # y' # it's\nb=12 f(1,x)"
    assert [(k, text[a:b]) for k, a, b, d in got[0] if d == 0] == [("key", "a"), (None, "="), ("string", "'x # y'"), (None, " "), ("comment", "# it's"), (None, "\n"), ("key", "b"), (None, "="), ("number", "12"), (None, " f("), ("number", "1"), (None, ",x)")]
    assert [(k, a, b) for k, a, b, d in got[1] if d == 1] == [("name", 0, 1), ("mark", 1, 2), (None, 2, 3), ("mark", 3, 4), (None, 4, 5), ("mark", 5, 6)]
    assert set(got) == {0, 1}


def test_greedy_rule_takes_tokens_it_starts_before(spark):
    text = "1 'a 2 b' 3 '4"
    rules = (Rule("number", r"\d"), Rule("string", r"'[^']*'", greedy=True))
    assert [(k, text[a:b]) for k, a, b, _ in spans(spark, [text], rules)[0]] == [("number", "1"), (None, " "), ("string", "'a 2 b'"), (None, " "), ("number", "3"), (None, " '"), ("number", "4")]
    inside = (Rule("word", r"x y"), Rule("late", r"y z", greedy=True))  # begins inside a token
    assert [k for k, *_ in spans(spark, ["x y z"], inside)[0]] == ["word", None]


def test_tokens_cover_the_text_and_ordinary_rules_equal_a_plain_loop(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b=", " ", "1", "'", "#", "(", ")", "f", "\n", ","]) for _ in range(rng.randrange(40))) for _ in range(200)]
    for rules in (RULES, tuple(Rule(r.kind, r.pattern, r.behind) for r in RULES)):
        got = spans(spark, texts, rules)
        for i, t in enumerate(texts):
            top = [(a, b) for _, a, b, d in got.get(i, []) if d == 0]
            assert [a for a, _ in top] + [len(t)] == [0] + [b for _, b in top]
            if rules is RULES:
                continue
            kinds = [None] * len(t)
            for n, r in enumerate(rules):
                at = 0
                while at < len(t):
                    if kinds[at] is not None:
                        at += 1
                        continue
                    stop = next((j for j in range(at, len(t)) if kinds[j] is not None), len(t))
                    m = re.compile(r.pattern, re.MULTILINE).search(t, at, stop)
                    a = m.start() + (len(m[1] or "") if r.behind else 0) if m else stop
                    if not m or a == m.end():
                        at = stop
                        continue
                    kinds[a : m.end()] = [(n, a)] * (m.end() - a)
                    at = m.end()
            want = {(rules[k[0]].kind, k[1]) for k in kinds if k}
            assert {(k, a) for k, a, _, _ in got.get(i, []) if k} == want, t
