"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (text between block-level tags). A block is described by
its words and link density and those of its two neighbours, and by where it stands: inside article
markup, outside it on a page that has some, inside an element that names itself a menu, notice,
advert, form, comment list and so on, or in a heading. A decision tree, fitted by Spark on the small labelled table ``LABELLED`` below,
tells main text from the rest; it is compiled into one Spark expression, so that only the reading of
markup is Python, in Arrow batches. Nothing is shuffled: a page's blocks stay in its row.

Defined cases: null, empty and blank pages give an empty text. Pages of any size are read whole.
Scripts, styles, comments in the markup and the head are no text, also if they never end. A tag that
never ends is read as text; a quoted attribute value ends at its quote, however far, and a quote that
is never closed counts as a character of its tag; end tags without a start are ignored. Equal rows give equal results, in
one row each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"'=]++|=\s*\"[^\"]*+\"|=\s*'[^']*+'|[=\"'])*+)>",
    re.S,
)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select", "object")}
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NESTED = frozenset("article aside body details dialog div dl fieldset figure footer form head header main menu nav ol section table ul blockquote button label td tr span".split())
_VOID_LIKE = frozenset("br wbr".split())
_AROUND = frozenset("nav footer aside form head dialog menu button label fieldset".split())
#: Words in a class, id or role by which an element says that it is not main text.
_HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|sidebar|"
    r"side|aside|comment\w*|reply|replies|respond|discussion|disqus|menu\w*|nav\w*|breadcrumb\w*|pagination|pager|footer|foot|masthead|header|topbar|toolbar|share|sharing|"
    r"social|related|recommend\w*|newsletter|subscribe|signup|login|register|search\w*|form|widget\w*|copyright|legal|disclaimer|skip|tags|toc)(?=$|[\s_-])",
    re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ["words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "outside_article", "hinted", "heading"]


def blocks(page: str | None) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, linked words, in_article, hinted, heading) of each block in page order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside article, hinted
    opened: Counter[str] = Counter()  # names in the stack
    text: list[str] = []
    linked: list[str] = []
    link, heading, at, page = 0, 0, 0, page or ""

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = "".join(text).split()
            if words:
                article, hinted = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((" ".join(words), len(words), len(" ".join(linked).split()), int(article), int(hinted), heading))
            text, linked = [], []

    def add(piece: str) -> None:
        if piece:
            piece = html_lib.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link:
                linked.append(piece)

    # behind the last '>' there is no tag, only perhaps a comment that never ends
    while m := (_TOKEN if page.find(">", at) >= 0 else _OPEN_COMMENT).search(page, at):
        add(page[at : m.start()])
        at, name = m.end(), m.groupdict().get("name")
        if name is None:
            continue
        name, ends = name.lower(), bool(m["end"])
        if name in _RAW:
            if not ends and not m["attrs"].endswith("/"):
                close = _RAW[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if name in _BLOCKS:
            flush()
        elif name in _VOID_LIKE:
            text.append(" ")
        if name == "a":
            link = 0 if ends else 1
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if ends else 1
        if name in _NESTED:
            if not ends:
                article, hinted = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                article = article or name in ("article", "main")
                around = name in _AROUND or (name == "header" and not article)
                stack.append((name, article, hinted or around or _says_so(name, m["attrs"])))
                opened[name] += 1
            elif opened[name]:
                gone = None
                while gone != name:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
            if name not in ("span", "label", "button"):
                link = heading = 0
    add(page[at:])
    flush()
    return out


def _says_so(name: str, attrs: str) -> bool:
    if not attrs or name in ("body", "article", "main"):
        return False
    return any(_HINTS.search(a[1] or a[2] or a[3]) for a in _ATTR.findall(attrs))


def _page(*parts: tuple[str, str]) -> list[tuple[str, str]]:
    return list(parts)


#: The labelled table: pages as lists of (markup, label of its blocks); "+" is main text.
LABELLED: list[list[tuple[str, str]]] = [
    _page(("<nav><ul><li><a href=x>Home</a></li><li><a href=x>World news</a></li></ul></nav>", "-"),
          ("<div class=ad>Buy two lamps and get the third one for free this week only.</div>", "-"),
          ("<article><h1>Storm closes the harbour</h1><p>The harbour stayed closed on Monday after a storm with winds of more than ninety kilometres an hour reached the coast.</p><p>No ship left.</p>", "+"),
          ("<section class=comments><p>I was there and it was the worst storm that I remember in all these years.</p></section>", "-"),
          ("</article><footer>&copy; The Harbour Post. All rights reserved by its owners.</footer>", "-")),
    _page(("<header><a href=x>The Daily</a> <p>News since 1901 for readers in all the valleys of the region and beyond.</p></header>", "-"),
          ("<main><h1>Bread</h1><p>Mix the flour with water and leave it.</p><p>Bake it.</p><p>Done.</p><p>See <a href=x>the other recipe</a>.</p>", "+"),
          ("<aside>More recipes from the same author that readers have liked in the past month.</aside>", "-"),
          ("</main><form><label>E-mail</label><p>Sign up to get our letter with ten new recipes each week, free of charge.</p></form>", "-")),
    _page(("<div id=cookie-notice>We use cookies to make this site better for you and to show adverts that you may like.</div>", "-"),
          ("<div id=top-menu><a href=x>Start</a> <a href=x>Shop</a> <a href=x>Contact us</a></div>", "-"),
          ("<div><p>The council voted on Tuesday to keep the old bridge open for another ten years, after engineers had found it sound.</p>", "+"),
          ("<p>Repairs are to begin in spring, and the road will be closed at night while the work on the deck goes on.</p></div>", "+"),
          ("<div><a href=x>Imprint</a> <a href=x>Privacy</a> <a href=x>Terms</a></div>", "-")),
    _page(("<article><p>One.</p><p>Two words.</p><ul><li>First item of the list</li><li>Second item</li></ul><blockquote>She said that it was fine.</blockquote>", "+"),
          ("<div class=share-bar><a href=x>Share</a> <a href=x>Send</a></div>", "-"),
          ("<p><a href=x>A whole paragraph that is one link to the report of the committee</a></p>", "+"),
          ("<div class='related-posts'><p>Why bridges last for centuries if people look after them, and why some do not.</p></div>", "-"),
          ("<table><tr><td>Height</td><td>12 m</td></tr></table></article>", "+"),
          ("<p>Last updated at noon by the editors of this page, who can be reached by post.</p>", "-")),
    _page(("<div><a href=x>Home</a></div><div><a href=x>Sports</a></div><div><a href=x>Culture and the arts</a></div>", "-"),
          ("<div>Scientists have found a new kind of moss that lives on the roofs of the oldest houses in the town, they said on Friday.</div>", "+"),
          ("<div>The moss grows by only one millimetre a year and can live through long dry summers without any harm to its leaves.</div>", "+"),
          ("<div><a href=x>Next page</a></div><div>Contact</div><div>Imprint</div>", "-")),
    _page(("<div class=sidebar><p>About me: I write about gardens, bees and the weather in the north, and I take photographs.</p></div>", "-"),
          ("<div class=post-body><p>My bees came through the winter well, and on the first warm day they were out at the willows by the river.</p><p>I gave them sugar in autumn, but they had left half of it untouched when I looked into the hive in March.</p></div>", "+"),
          ("<div class=comment-list><p>Mine did not make it this year, sadly, although I had fed them as much as you did.</p><p>Great to read!</p></div>", "-"),
          ("<div class=footer>Theme by nobody in particular, hosted somewhere on a quiet machine.</div>", "-")),
    _page(("<p>Home</p>", "-"),
          ("<article><h1>A title alone</h1><h2>And one below</h2><p>Word.</p><h2>Part</h2><p><a href=x>Link</a></p></article>", "+"),
          ("<p>Printed on recycled paper in the old mill at the end of the lane by four people.</p><p>Top</p>", "-")),
    _page(("<div><a href=x>Log in</a> | <a href=x>Basket</a></div>", "-"),
          ("<h1>How the mill was saved</h1><p>For forty years the mill stood empty, and the rain came in through the roof and rotted the floors.</p>", "+"),
          ("<p>Then a baker bought it.</p><p>She and her friends spent six summers on the walls, the wheel and the weir, and paid for most of it themselves.</p><p>It works again.</p>", "+"),
          ("<p>On Saturdays visitors can watch the stones turn and buy a loaf that was baked from the flour of the same morning.</p>", "+"),
          ("<p><a href=x>Older</a></p><p><a href=x>Newer</a></p><p>Imprint</p>", "-")),
    _page(("<nav>Menu</nav>", "-"),
          ("<article><h2>Short</h2><p>Yes.</p><p>No.</p><pre>x = 1</pre>", "+"),
          ("<form><p>Leave a reply with your name and the text that you would like to see below this article.</p></form></article>", "-"),
          ("<div class=newsletter-box>Get the best stories of the week by mail every Sunday morning at eight.</div>", "-")),
]


def labelled_blocks() -> list[tuple]:
    """Rows of the features and the label (1 for main text)."""
    rows = []
    for page in LABELLED:
        labels, found, markup = [], [], ""
        for piece, label in page:
            markup += piece
            found = blocks(markup)
            labels += [1.0 if label == "+" else 0.0] * (len(found) - len(labels))
        density = [b[2] / b[1] for b in found]
        article = any(b[3] for b in found)
        for i, b in enumerate(found):
            before, after = i - 1, i + 1
            rows.append((
                float(b[1]), density[i],
                float(found[before][1]) if before >= 0 else 0.0, density[before] if before >= 0 else 0.0,
                float(found[after][1]) if after < len(found) else 0.0, density[after] if after < len(found) else 0.0,
                float(b[3]), float(article and not b[3]), float(b[4]), float(b[5]), labels[i],
            ))
    return rows


def fit_tree(spark: SparkSession, rows: list[tuple] | None = None, depth: int = 6):
    """A decision tree over ``FEATURES``, fitted on the labelled table."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    table = spark.createDataFrame([(Vectors.dense(r[:-1]), r[-1]) for r in rows or labelled_blocks()], ["features", "label"]).coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table)


def tree_expression(model, features: dict[str, Column]) -> Column:
    """The tree as nested conditions over the columns of ``features``; true for main text."""

    def grow(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        return F.when(features[FEATURES[split.featureIndex()]] <= split.threshold(), grow(node.leftChild())).otherwise(grow(node.rightChild()))

    return grow(model._call_java("rootNode"))


_BLOCK_TYPE = "array<struct<text:string,words:int,linked:int,in_article:int,hinted:int,heading:int>>"


def block_lists(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("text", "words", "linked", "in_article", "hinted", "heading")
    for batch in pages:
        yield pd.Series([[dict(zip(names, b, strict=True)) for b in blocks(p)] for p in batch])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", model=None) -> DataFrame:
    """The columns ``keep``, the blocks with their verdicts, and the main text."""
    model = model or fit_tree(pages.sparkSession)
    found = pages.select(*keep, F.pandas_udf(block_lists, _BLOCK_TYPE)(F.col(html)).alias("blocks"))
    found = found.withColumn("_article", F.exists("blocks", lambda b: b.in_article == 1))

    def verdict(b: Column, i: Column) -> Column:
        def words(x: Column) -> Column:
            return F.coalesce(x.words.cast("double"), F.lit(0.0))

        def density(x: Column) -> Column:
            return F.coalesce(x.linked.cast("double") / x.words, F.lit(0.0))

        before, after = F.get("blocks", i - 1), F.get("blocks", i + 1)
        values = [words(b), density(b), words(before), density(before), words(after), density(after)]
        values += [b.in_article.cast("double"), (F.col("_article") & (b.in_article == 0)).cast("double")]
        values += [b.hinted.cast("double"), b.heading.cast("double")]
        return tree_expression(model, dict(zip(FEATURES, values, strict=True)))

    text = F.array_join(F.transform(F.filter("blocks", verdict), lambda b: b.text), "\n\n")
    return found.select(*keep, "blocks", text.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
