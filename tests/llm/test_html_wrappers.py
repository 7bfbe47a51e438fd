"""Pages whose article lies in a form, header or unclosed element, in a second template, or under a misleading name; and
page scoring against a second version over a tree."""

import random
import time
from html.parser import HTMLParser

import pytest

from taxrecon.llm import html_extract as M

LINES = [f"Sentence number {i} of the article, which goes on for a while and says things." for i in range(12)]
PROSE, TEXT = "".join(f"<p>{x}</p>" for x in LINES), "\n".join(LINES)
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul>"


@pytest.mark.parametrize("open_, close", [("<form runat=server>", "</form>"), ("<fieldset>", "</fieldset>"), ("<form><fieldset>", "</fieldset></form>"), ("<header>", "</header>"), ("<nav><a href=x>a</a>", ""), ("<aside>", ""), ("<div role=form>", "</div>")])
def test_articles_in_wrappers_stay(open_, close):
    page = f"<body>{open_}{MENU}<article>{PROSE}</article><footer>A footer whose text is long enough to count as prose.</footer>{close}</body>"
    assert M.extract(page, None) == TEXT


@pytest.mark.parametrize("open_, close", [("<form action=/>", "</form>"), ("<fieldset>", "</fieldset>"), ("<header>", "</header>"), ("<nav>", ""), ("<footer>", "")])
def test_text_without_article_tags_in_wrappers_stays(open_, close):
    assert M.extract(f"<body>{open_}<div class=story>{PROSE}</div>{close}", None) == TEXT


def test_what_is_not_around_the_article_goes():
    form = "<form><p>Your email address will not be published, required fields are marked.</p></form>"
    teaser = "<aside><article><p>A teaser that is long enough to be prose of its own, as teasers are.</p></article></aside>"
    for extra in (form, teaser, "<footer><p>" + LINES[0] + "</p></footer>", "<nav>" + LINES[0] + "</nav>", f"<form class=comment-form>{PROSE}{PROSE}</form>", f"<div role=search>{LINES[0]}</div>"):
        assert M.extract(f"<body><article>{PROSE}{extra}</article></body>", None) == TEXT
        assert M.extract(f"<body><div class=story>{PROSE}</div>{extra if 'comment-form' not in extra else ''}</body>", None) == TEXT
    assert M.extract(f"<body><footer>{PROSE}</footer></body>", None) == ""
    assert M.extract("<body><form><label>User</label><label>Password</label></form></body>", None) == ""


def test_a_name_alone_takes_no_long_part_of_an_article():
    for name in ("id=search", "class=social", "class=alert"):
        assert M.extract(f"<body><article>{PROSE}<section {name}><h2>On it</h2>{PROSE}</section></article>", None) == f"{TEXT}\nOn it\n{TEXT}"
    assert M.extract(f"<body><article>{PROSE}<section id=comments>{PROSE}</section></article>", None) == TEXT
    links = "".join(f"<p><a href=x>{x}</a></p>" for x in LINES)
    assert M.extract(f"<body><article>{PROSE}<div class=social>{links}</div></article>", None) == TEXT


def test_second_template_of_a_host(spark):
    rows = [(i, f"http://h/{i}", f"<body><div class=main><div class=text><p>Page {i}.</p>{PROSE}</div></div>") for i in range(5)]
    rows.append((9, "http://h/9", f"<body><div class=main><div class=text>Teaser only.</div><div class=story>{PROSE}</div></div>"))
    out = {r["page_id"]: r["text"] for r in M.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[i] == f"Page {i}.\n{TEXT}" for i in range(5)) and TEXT in out[9]


def test_wrapped_pages_of_a_host(spark):
    rows = [(i, f"http://h/{i}", f"<body><form runat=server>{MENU}<div class=text><p>Page {i}.</p>{PROSE}</div></form>") for i in range(6)]
    out = [r["text"] for r in M.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]
    assert out == [f"Page {i}.\n{TEXT}" for i in range(6)]


def test_time_is_linear_in_wrappers():
    for page in ("<form>" * 60_000 + PROSE, "<form><article><p>" * 30_000, "<nav></nav><header>" * 30_000):
        start = time.time()
        M.extract(page, None)
        assert time.time() - start < 20


class Tree(HTMLParser):
    """A page as nested (tag, classes, children), children being texts (in a link or not) and elements."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ("root", "", [], None)
        self.links = 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs).get("class") or "", [], self.at)
        self.at[2].append(node)
        self.at, self.links = node, self.links + (tag == "a")

    def handle_endtag(self, tag):
        self.at, self.links = self.at[3], self.links - (tag == "a")

    def handle_data(self, data):
        self.at[2].append((" ".join(data.split()), self.links > 0))


def second_version(page):
    """Of a well-formed page without hints: nodes with equal paths are one; the best container by own text outside links
    and, at 0.6 a level, what lies up to three deeper; the outermost article around it."""
    worth, texts = {}, {}

    def walk(node, path):
        if node[0] in ("section", "div", "article", "main", "body", "td"):
            path = (*path, node[0] + ("." + node[1] if node[1] else ""))
        for child in node[2]:
            if len(child) == 2:
                worth[path] = worth.get(path, 0) + (-len(child[0]) if child[1] else len(child[0]))
                texts.setdefault(path, []).append(child[0])
            else:
                walk(child, path)

    walk(Tree(page).root, ())
    score = {}
    for path, w in worth.items():
        for k in range(4):
            if w > 0 and len(path) >= k:
                up = path[: len(path) - k]
                score[up] = score.get(up, 0) + w * 0.6**k
    return {p: s * (1.5 if p and p[-1].split(".")[0] in ("article", "main") else 1) for p, s in score.items() if s > 0}


def test_scores_against_a_tree():
    r = random.Random(11)

    def part(depth):
        tag = r.choice(["div", "div", "section", "article", "main"])
        inner = "".join(r.choice([f"<p>{'x' * r.randrange(1, 60)}</p>", f"<p><a href=z>{'y' * r.randrange(1, 20)}</a></p>", part(depth + 1) if depth < 4 else ""]) for _ in range(r.randrange(1, 5)))
        return f"<{tag} class=k{r.choice('abc')}>{inner}</{tag}>"

    for _ in range(300):
        page = f"<body>{''.join(part(0) for _ in range(3))}</body>"
        read = M.Page(page)
        got = {tuple(read.path(i).split(">")) if i else (): s for i, s in read.scores().items() if s > 0}
        want = second_version(page)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-6 for p in want)
