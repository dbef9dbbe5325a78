"""Main text of web pages from flat text blocks and a decision tree (operator 5).

A page is cut into text blocks at block-level tags.  Each block has its word
count, its link density, those of the blocks before and after it, the words,
link density, controls and share of the page of the box it stands in, and
counts of what wraps it: tags of menus, notices, forms and the like, names of
such parts, names of reader comments.  A name counts only as a whole class, id
or role (``_named``), and what wraps the main part, or most of a page without
one, speaks against nothing (``_place``).  A Spark ML decision tree, trained on
the small labelled table of ``labelled_blocks``, in which such names stand on
both sides, says which blocks are main text.  The tree, of depth 12 at most,
goes to the tasks as a list.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags that end a block, tags without content, tags whose content is never text.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li
 main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg math object canvas audio video textarea select iframe head title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIDE_TAGS = frozenset("nav footer aside form button label menu dialog fieldset".split())
BOX_TAGS = frozenset("address article aside blockquote body center details dialog div dl fieldset footer form header li main menu nav ol section table td tr ul".split())
CONTROLS = frozenset("button input select textarea".split())
SIDE_WORDS = frozenset("""ad ads adv advert advertisement advertising alert author-box banner breadcrumb breadcrumbs byline
 consent contentinfo complementary cookie cookies copyright dialog disclaimer donate foot footer gdpr head-menu legal links
 login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup
 promo promotion recommended register related search share sharing sidebar side signup skip social sponsor sponsored
 subscribe subscription survey tags teaser toolbar topbar trending warning widget widgets""".split())
TALK_WORDS = frozenset("comment comments discussion discussions disqus feedback guestbook replies reply respond response responses".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text".split())
#: Words beside which a name stays what it is: "site-footer" is a footer, "side-effects" no side.
PLAIN_WORDS = frozenset("""area article bar block body bottom box button buttons col column container content desktop entry form global
 group head header holder inner item items layout left list main mobile module more outer page panel popular post posts primary reader
 readers recent right row secondary section site sticky sub text thread title top user users wrap wrapper""".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|href|aria-hidden|y)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HINT = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
FEATURES = ("words", "links", "prose_near", "words_before", "links_before", "words_after", "links_after", "box_words", "box_links", "box_controls",
            "box_share", "ends_sentence", "heading", "place", "side_tags", "side_names", "talk_names")


def _named(attrs: dict[str, str], tag: str) -> tuple[int, int, bool]:
    """(names of side parts, names of reader comments, whether a name is the main part's).

    A name is a whole class, id or role, or a compound in which nothing but
    plain words stands beside it.  The id of a heading is a link target and
    says nothing of where it stands.
    """
    side, talk, main = set(), set(), False
    for key in ("class", "id", "role"):
        if key == "id" and tag in HEADINGS:
            continue
        for name in attrs.get(key, "").split():
            parts = {w.lower() for w in HINT.findall(name)}
            whole = parts | {name.lower()}
            main = main or bool(whole & MAIN_WORDS)
            beside = parts - SIDE_WORDS - TALK_WORDS - PLAIN_WORDS
            if whole & TALK_WORDS and not beside:
                talk.add(name.lower())
            elif name.lower() in SIDE_WORDS or (whole & SIDE_WORDS and not beside) or (name.lower() == "header" and tag != "header"):
                side.add(name.lower())
    return len(side), len(talk), main


def _marks(tag: str, attrs: dict[str, str], in_main: bool) -> tuple[list[int], bool, bool]:
    """([tags, side names, comment names] that speak against an element, whether it opens the main part, whether it is hidden)."""
    side, talk, named = _named(attrs, tag)
    marks = [int(tag in SIDE_TAGS or (tag == "header" and not in_main)), side, talk]
    main = tag in ("article", "main") or (not any(marks) and named and tag in ("div", "section", "td"))
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    return marks, main, hidden


def _place(out: list[dict], boxes: list[dict]) -> None:
    """Adds what the boxes say to their blocks.

    The main part is the opening box with most words, each mark around it
    quartering them unless it holds most of the page, so that an article beside
    its comments is the main part.  Marks of the boxes around it (without one,
    of those that hold most of the page's words) count for nothing.  A block's
    box is the outermost marked one around it, or the nearest.  Boxes stand
    after those around them, so each step is one pass.
    """
    for b in out:
        boxes[b["box"]]["words"] += b["words"]
        boxes[b["box"]]["linked"] += b["linked"]
    for box in reversed(boxes[1:]):
        for k in ("words", "linked"):
            boxes[box["up"]][k] += box[k]
    page = boxes[0]["words"]
    openers = []
    for i, box in enumerate(boxes):
        around = boxes[box["up"]]["around"] if i else 0
        box["around"] = around + (0 if 2 * box["words"] > page else sum(box["marks"]))
        if box["opens"] and box["words"]:
            openers.append((box["words"] / 4 ** box["around"], -i))
    wrappers = {i for i, box in enumerate(boxes) if 2 * box["words"] > page} if not openers else set()
    at = -max(openers)[1] if openers else 0
    while openers and at:
        wrappers.add(at)
        at = boxes[at]["up"]
    for i, box in enumerate(boxes):
        up = boxes[box["up"]] if i else {"sum": [0, 0, 0], "outer": None}
        own = [0, 0, 0] if i in wrappers else box["marks"]
        box["sum"] = [x + y for x, y in zip(up["sum"], own)]
        box["outer"] = up["outer"] if up["outer"] is not None else i if any(own) else None
    for b in out:
        own = boxes[b.pop("box")]
        b["side_tags"], b["side_names"], b["talk_names"] = own["sum"]
        box = own if own["outer"] is None else boxes[own["outer"]]
        b["box_words"], b["box_links"] = box["words"], box["linked"] / box["words"]
        b["box_controls"], b["box_share"] = 100.0 * box["controls"] / box["words"], box["words"] / page


def blocks(page: str) -> list[dict]:
    """Text blocks of a page in order, with their features (and the training mark y where given)."""
    out: list[dict] = []
    stack: list[tuple] = []                # tag, state around it
    state = (0, False, False, False, None)    # box around, in main, silent, heading, y
    boxes = [{"up": 0, "marks": [0, 0, 0], "opens": False, "words": 0, "linked": 0, "controls": 0}]
    parts: list[str] = []
    linked = 0
    link = False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            n = len(text.split())
            box, main, _, heading, y = state
            out.append({"text": text, "words": n, "linked": min(n, linked), "links": min(1.0, linked / n), "in_main": int(main), "box": box,
                        "heading": int(heading), "ends_sentence": int(text[-1] in ".!?:;…\"'”)"), "y": y})
        parts, linked = [], 0

    def say(s: str) -> None:
        nonlocal linked
        if s and not state[2]:
            parts.append(s)
            if link:
                linked += len(s.split())

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos:m.start()])
        pos = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing = m.group(1) or m.group(4)
        if tag in ("a",):
            link = not closing and "href" in (m.group(3) or m.group(6) or "").lower()
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if tag == "br":
            say(" ")
        if tag in CONTROLS and not closing and not state[2]:
            boxes[state[0]]["controls"] += 1
        if tag in VOID_TAGS:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    state = stack[i][1]
                    del stack[i:]
                    if block:
                        link = False
                    break
            continue
        if not block and tag not in SILENT_TAGS:
            continue
        if block and stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td"))):
            state = stack.pop()[1]          # these end where the next block begins
        box, main, silent, heading, y = state
        attrs = {a.group(1).lower(): (a.group(2) or a.group(3) or a.group(4) or "") for a in ATTR.finditer(m.group(3) or m.group(6) or "")}
        marks, opens, hidden = _marks(tag, attrs, main)
        stack.append((tag, state))
        marks = [0, 0, 0] if tag in ("html", "body") else marks
        if any(marks) or (opens and not main) or tag in BOX_TAGS:
            boxes.append({"up": box, "marks": marks, "opens": opens and not main, "words": 0, "linked": 0, "controls": 0})
            box = len(boxes) - 1
        state = (box, main or opens, silent or hidden or tag in SILENT_TAGS, tag in HEADINGS, attrs.get("y", y))
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, pos)
            pos = stop.start() if stop else end
    flush()
    has_main = int(any(b["in_main"] for b in out))
    if out:
        _place(out, boxes)
    prose = [b["words"] - b["linked"] for b in out]
    for i, b in enumerate(out):
        b["place"] = 1 if b["in_main"] else -has_main      # in the main part, outside it, on a page without one
        b["prose_near"] = sum(prose[max(0, i - 2):i + 3])
        for name, j in (("before", i - 1), ("after", i + 1)):
            near = out[j] if 0 <= j < len(out) else {"words": 0, "links": 0.0}
            b[f"words_{name}"], b[f"links_{name}"] = near["words"], near["links"]
    return out


#: The labelled pages: N stands for a run of filler words; y=1 marks main text, y=0 the rest.
LABELLED_PAGES = (
    '<body><nav y=0><ul><li><a href="/">N2</a><li><a href="/b">N1</a><li><a href="/c">N2</a></ul></nav>'
    '<div class="ad" y=0>N9</div><article y=1><h1>N8.</h1><p>N60.</p><p>N2.</p><p>N35.</p><p>N1.</p><p>N90.</p></article>'
    '<footer y=0>N6 <a href="/i">N1</a></footer></body>',
    '<body><header y=0><a href="/">N2</a><p>N5</p></header><main y=1><h1>N6</h1><p>N45.</p><ul><li>N7</li><li>N4</li></ul>'
    '<blockquote>N20.</blockquote><p>N3.</p><aside y=0><p>N25.</p></aside><p>N70.</p></main>'
    '<aside y=0><h3>N2</h3><ul><li><a href="x">N6</a></li><li><a href="y">N5</a></li></ul></aside><footer y=0><p>N12.</p></footer></body>',
    '<body><div id="menu" y=0><a href="1">N1</a> <a href="2">N1</a> <a href="3">N2</a></div><div class="cookie-notice" y=0><p>N22.</p>'
    '<button>N2</button></div><div id="content" y=1><h2>N7</h2><p>N80.</p><p>N4.</p><p>N50 <a href="z">N2</a> N20.</p></div>'
    '<div class="comments" y=0><h3>N2</h3><div class="comment"><p>N30.</p></div><div class="comment"><p>N45.</p></div></div>'
    '<div class="footer" y=0>N8</div></body>',
    '<body><div y=0><a href="1">N1</a> | <a href="2">N1</a> | <a href="3">N1</a> | <a href="4">N2</a></div><div y=1><h1>N6</h1><p>N70.</p>'
    '<p>N55.</p><p>N12.</p><p>N64.</p></div><div y=0><a href="5">N8</a></div><div y=0><a href="6">N7</a></div><div y=0>N5</div></body>',
    '<body><form y=0><label>N2</label><input><p>N8.</p></form><article y=1><header><h1>N9</h1></header><section><h2>N3</h2><p>N40.</p>'
    '<p>N33.</p></section><div class="related" y=0><p>N2</p><a href="1">N8</a></div><section><h2>N4</h2><p>N52.</p></section>'
    '<section id="comments" y=0><p>N26.</p><p>N31.</p></section><footer y=0>N9</footer></article><div class="sidebar" y=0><p>N28.</p></div></body>',
    '<body><table><tr><td y=0><a href="1">N2</a><br><a href="2">N2</a></td><td y=1><p>N66.</p><p>N41.</p><p>N9.</p></td>'
    '<td y=0><p>N4</p><a href="3">N3</a></td></tr></table><p y=0>N4</p></body>',
    '<body><div class="banner" role="alert" y=0>N14.</div><main y=1><article><h1>N5</h1><pre>N30</pre><p>N20.</p><table><tr><td>N3<td>N2</tr>'
    '</table><p>N48.</p><div class="newsletter" y=0><h4>N4</h4><p>N18.</p></div><p>N15.</p></article></main></body>',
    '<body><nav y=0><a href="0">N2</a></nav><article y=1><h1><a href="1">N7</a></h1><p>N6 <a href="2">N4</a> N3.</p><p><a href="3">N5</a></p>'
    '<p><a href="4">N2</a> N30 <a href="5">N9</a>.</p><ul><li><a href="6">N3</a></li><li><a href="7">N4</a> N2</li></ul><p>N25.</p></article></body>',
    '<body><main y=1><p><a href="1">N12</a> N8.</p><p>N2 <a href="2">N1</a></p><h3>N3</h3><p><a href="3">N6</a>.</p></main><div y=0><a href="4">N3</a></div></body>',
    '<body><p y=1>N40.</p><p y=1>N62.</p><p y=1>N5.</p><p y=1>N37.</p></body>',
    '<body><article y=1><h1>N4</h1><p>N1.</p></article><footer y=0>N30.</footer></body>',
    '<body class="single has-sidebar"><nav y=0><a href="1">N2</a></nav><div id="page" class="site has-footer"><article class="post comments-open" y=1>'
    '<h1>N6</h1><p>N48.</p><p>N3.</p><p>N37.</p></article><div class="comments" y=0><p>N26.</p></div></div><div class="footer" y=0>N9</div></body>',
    '<body><form id="page" class="has-sidebar"><div y=1><p>N50.</p><p>N42.</p><p>N38.</p></div><div class="sidebar" y=0><p>N11.</p></div></form></body>',
    '<body><div class="header" y=0><p>N10.</p></div><p y=1>N34.</p><p y=1>N44.</p><ul class="social" y=0><li><a href="1">N1</a><li>N2</ul></body>',
    '<body><nav y=0><a href="1">N1</a></nav><article y=1><h1>N6</h1><p>N50.</p><section id="search"><h2>N3</h2><p>N60.</p><p>N44.</p></section>'
    '<section class="links"><p>N70.</p><p>N40 <a href="2">N2</a></p></section><section class="share"><p>N33.</p><p>N52.</p></section></article>'
    '<section class="responses" y=0><h3>N2</h3><p>N40.</p><p>N62.</p><p>N9.</p></section></body>',
    '<body><div y=0><p>N20.</p><button>N2</button></div><div y=0><a href="1">N1</a> <a href="2">N2</a></div><main y=1><h1>N5</h1><p>N58.</p><p>N3.</p>'
    '<p>N47.</p></main><div y=0><p>N16.</p><input><button>N1</button></div></body>',
    '<body><div y=1><h1>N7</h1><p>N64.</p><p>N48.</p><p>N5.</p><p>N39.</p></div><div y=0><p>N18 <a href="1">N2</a>.</p><button>N2</button><button>N1</button></div></body>',
    '<body><div y=0><p>N24.</p><button>N1</button></div><div y=1><div><h2>N5</h2></div><div><p>N46.</p></div><div><p>N61.</p><p>N4.</p></div><div><p>N38.</p></div></div>'
    '<div class="replies" y=0><div><p>N34.</p></div><div><p>N51.</p></div></div></body>',
    '<body><article y=1><h1>N6</h1><p>N55.</p><ul><li><a href="1">N4</a></li><li><a href="2">N5</a></li><li><a href="3">N3</a></li></ul><p>N24.</p></article>'
    '<div y=0><ul><li><a href="4">N4</a></li><li><a href="5">N6</a></li></ul></div></body>',
    '<body><div y=0><ul><li><a href="8">N1</a></li><li><a href="9">N2</a></li></ul></div><div y=1><h1>N5</h1><p>N62.</p><p>N50.</p><ul><li><a href="1">N4</a></li>'
    '<li><a href="2">N5</a></li></ul><p>N27.</p></div><div y=0>N6</div></body>',
    '<body><div class="widget" y=1><h2>N4</h2><p>N56.</p><p>N2.</p><p>N71.</p></div><div class="widget" y=0><h4>N2</h4><ul><li><a href="1">N3</a></li><li><a href="2">N4</a></li></ul></div>'
    '<div class="widget" y=0><p>N7.</p></div></body>',
    '<body><article y=1><h1>N5</h1><p>N42.</p><div class="notice"><p>N58.</p><p>N46.</p><p>N63.</p></div><p>N36.</p><div class="notice" y=0><p>N9.</p></div>'
    '<div class="discussion" y=0><p>N44.</p><p>N57.</p><p>N38.</p></div></article><footer y=0><p>N10.</p></footer></body>',
    '<body><main y=1><h1>N4</h1><section class="promotion"><p>N66.</p><p>N54.</p></section><section id="survey"><h2>N2</h2><p>N59.</p><p>N8.</p><p>N72.</p></section></main>'
    '<aside y=0><p>N30.</p></aside><div class="ad" y=0><p>N20.</p></div></body>',
    '<body><nav y=0><a href="1">N1</a></nav><div class="ad" y=0>N30.</div><article y=1><h1>N4</h1><p>N6.</p></article><footer y=0>N14.</footer></body>',
    '<body><div class="cookies" y=0><p>N40.</p></div><main y=1><p>N9.</p></main><div class="sidebar" y=0><p>N25.</p><p>N19.</p></div></body>',
    '<body><article y=1><h1>N5</h1><p>N20.</p><p>N31.</p><button y=0>N1</button><p>N3.</p><button y=0>N2</button><p>N17.</p></article><div y=0><p>N15.</p><button>N1</button></div></body>',
    '<body><div class="content" y=1><h1>N6</h1><p>N46.</p><p>N4.</p><p>N38.</p><div class="replies" y=0><p>N33.</p></div><div class="sidebar" y=0><p>N31.</p></div></div></body>',
    '<body><div class="story" y=1><p>N35.</p><p>N52.</p><div class="sponsor" y=0><p>N24.</p></div><p>N28.</p><div class="sidebar" y=0><p>N22.</p><p>N8.</p></div></div></body>',
    '<body><main y=1><input><h1>N4</h1><p>N9.</p><p>N12.</p><div y=0><p>N6.</p><input><button>N1</button></div></main></body>',
    '<body><div y=1><button y=0>N1</button><h1>N6</h1><p>N46.</p><p>N63.</p><button y=0>N1</button><p>N37.</p></div><div y=0><p>N13.</p><button>N2</button></div></body>',
    '<body><ul y=0><li><a href="1">N1</a></li><li><a href="2">N2</a></li><li><a href="3">N1</a></li></ul><div y=1><h1>N6</h1></div><div y=1><p>N45.</p></div>'
    '<div y=1><p>N64.</p></div><div y=1><h3>N3</h3></div><div y=1><p>N52.</p></div><div y=1><p>N12.</p></div><div y=1><p>N57.</p></div><div y=0><p>N5</p></div>'
    '<div y=0><a href="4">N2</a> <a href="5">N2</a></div></body>',
    '<body><div y=0><a href="1">N2</a></div><div y=0><p>N17.</p><button>N1</button><button>N2</button></div><div y=1><p>N70.</p></div><div y=1><p>N31.</p></div>'
    '<div y=1><p>N48 <a href="2">N3</a>.</p></div><div y=1><p>N55.</p></div><div class="discussion" y=0><p>N42.</p><p>N36.</p></div><div y=0><p>N8</p></div></body>',
)
SCALES = (0.3, 0.6, 1.0, 1.6, 2.5, 4.0)
SPREADS = (1.0, 4.0, 9.0)


def labelled_blocks() -> list[dict]:
    """The small labelled table: blocks of the labelled pages with runs of several lengths.

    A run is ``SCALES`` times its stated length, times a factor that differs
    from run to run by up to one of ``SPREADS``, so that short articles stand
    beside long notices and the other way round.
    """
    rows = []
    for page in LABELLED_PAGES:
        for i, (k, spread) in enumerate((k, s) for k in SCALES for s in SPREADS):
            at = itertools.count(i)
            length = lambda n: max(1, round(n * k * spread ** (next(at) * 0.618034 % 1 - 0.5)))  # noqa: B023, E731
            filled = re.sub(r"(?<![A-Za-z])N(\d+)", lambda m: " ".join(["word"] * length(int(m.group(1)))), page)  # noqa: B023
            rows += [b for b in blocks(filled) if b["y"] is not None]
    return rows


def train_tree(spark: SparkSession, max_depth: int = 12) -> list[tuple]:
    """Nodes (feature, threshold, left, right, prediction) of a decision tree over the labelled table."""
    data = spark.createDataFrame([(float(b["y"]), Vectors.dense([float(b[f]) for f in FEATURES])) for b in labelled_blocks()],
                                 ["label", "features"])
    model = DecisionTreeClassifier(maxDepth=max_depth, maxBins=128, minInstancesPerNode=3, seed=1).fit(data.coalesce(1))
    nodes: list[tuple] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.getClass().getSimpleName() == "LeafNode":
            nodes[at] = (-1, 0.0, -1, -1, int(node.prediction()))
        else:
            left, right = add(node.leftChild()), add(node.rightChild())
            nodes[at] = (int(node.split().featureIndex()), float(node.split().threshold()), left, right, 0)
        return at

    add(model._java_obj.rootNode())
    return nodes


def is_main(block: dict, tree: list[tuple]) -> bool:
    at = 0
    while tree[at][0] >= 0:
        feature, threshold, left, right, _ = tree[at]
        at = left if block[FEATURES[feature]] <= threshold else right
    return tree[at][4] == 1


def extract(pages: DataFrame, tree: list[tuple] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks, n_main.

    Null html counts as empty; a page without main text has the empty text.
    Broken markup never fails: an unclosed tag ends with its surroundings, a
    tag cut off at the end is dropped.  Repeated rows are extracted each; null
    ids and urls pass through.  An empty table gives an empty result; other
    columns are ignored.
    """
    tree = tree or train_tree(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n, kept = [], [], []
            for page in b.column(2):
                found = blocks(page.as_py())
                main = [x["text"] for x in found if is_main(x, tree)]
                text.append("\n".join(main))
                n.append(len(found))
                kept.append(len(main))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array(n, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
