"""Hand-made layouts that the generator of labelled pages does not write: what is kept by kind of block, and what leaks in."""

from collections import defaultdict

import pytest

from weftline.llm import html_extract

#: Ways in which pages hold an article (``@``) beside other parts.
LAYOUTS = [
    "<body><header><a href=/>Zenith</a></header><nav><a href=/a>Ztop</a> <a href=/b>Zmore</a></nav><main><article>@</article></main><footer>Zfoot</footer></body>",
    "<body><div id=header><h1>Zsite</h1><ul class=menu><li><a href=/a>Ztop</a></li><li><a href=/b>Zmore</a></li></ul></div><div id=content><h1>Low water</h1>@</div><div id=sidebar><ul><li><a href=/c>Zside</a></li></ul></div></body>",
    "<body><table><tr><td class=sidebar><ul><li><a href=/c>Zside</a></li><li><a href=/d>Zpast</a></li></ul></td><td class=content><h2>Low water</h2>@</td></tr></table><div class=footer>Zfoot</div></body>",
    "<body><main role=main class='main wide'>@<section class=comments><h3>Zcomments</h3><article class=comment><p>Zthanks for this</p><button>Zreply</button></article></section></main></body>",
    "<body><div class=page><nav class=breadcrumb><a href=/>Zhome</a> &gt; <a href=/x>Zwater</a></nav><article class='post story'><h1>Low water</h1>@<aside><h3>Zrelated</h3><ul><li><a href=/r>Zother</a></li></ul></aside></article><form class=newsletter><label>Zmail</label><button>Zjoin</button></form></div></body>",
    "<body><div class='cookie banner'><p>Zcookies are used</p><button>Zagree</button></div><section class='article body'><header><h1>Zhead of it</h1></header>@</section><footer><nav><a href=/l>Zlegal</a></nav></footer></body>",
    "<article><h1>Low water</h1><div class=ad><a href=/buy>Zbuy</a></div>@</article><aside class=sidebar><p>Zabout the author</p></aside>",
    "<html><head><title>Zt</title><script>Zs</script></head><body><div class=wrapper><div class='entry text'><div class=inner>@</div></div><div class='share social'><a href=/t>Zshare</a></div></div></body></html>",
    "<body><div id=top><a href=/>Zhome</a></div><div class=cols><div class='story main'><div class=copy><div>@</div></div></div><div class='widget related'><h4>Zread more</h4><ol><li><a href=/q>Znext</a></li></ol></div></div></body>",
]
#: Blocks by kind, with the text that has to be kept.
BLOCKS = {
    "paragraph": [("<p>The gauge had been still for weeks.</p>", ["The gauge had been still for weeks."]), ("<p>No.</p>", ["No."])],
    "button": [("<p>Press the <button>Start</button> key to begin the survey of the lower valley.</p>", ["Press the Start key to begin the survey of the lower valley."]), ("<ol><li>Hold <button>Set</button> for a second.</li></ol>", ["Hold Set for a second."])],
    "link list": [("<ul><li><a href='/s1'>Survey of 1911</a></li><li><a href='/s2'>Letters of the warden</a></li></ul>", ["Survey of 1911", "Letters of the warden"]), ("<h2>Sources</h2><ol><li><a href=a>Alpha</a><li><a href=b>Beta</a></ol>", ["Sources", "Alpha", "Beta"])],
    "linked paragraph": [("<p><a href='/x'>Read the whole letter of the warden</a></p>", ["Read the whole letter of the warden"])],
    "caption": [("<figure><img src=m.png alt=''><figcaption>The mill in frost</figcaption></figure>", ["The mill in frost"]), ("<figure><a href=m><img src=m></a><figcaption><a href=c>The mill, by night</a></figcaption></figure>", ["The mill, by night"])],
    "table": [("<table><caption>Levels</caption><tr><th>Year</th><td>1911</td></tr></table>", ["Levels", "Year", "1911"])],
    "quote": [("<blockquote><p>Water finds its way.</p><cite>the warden</cite></blockquote>", ["Water finds its way.", "the warden"])],
    "code": [("<pre><code>level = 3\nprint(level)</code></pre>", ["level = 3 print(level)"])],
    "definition": [("<dl><dt>Weir</dt><dd>A low dam across a river.</dd></dl>", ["Weir", "A low dam across a river."])],
    "section": [("<section><h3>Afterwards</h3><p>The bridge held.</p></section>", ["Afterwards", "The bridge held."])],
    "details": [("<details><summary>Method</summary><p>Read twice a day.</p></details>", ["Method", "Read twice a day."])],
}
LEAD = "<p>The river rose in the night, and nobody in the lower fields had expected it before the morning.</p>"


@pytest.fixture(scope="module")
def results():
    kept, leaks = defaultdict(list), []
    for layout in LAYOUTS:
        for kind, blocks in BLOCKS.items():
            for block, want in blocks:
                for body in (LEAD + block, block + LEAD, LEAD + block + LEAD, LEAD + block * 3):
                    text = html_extract.main_text(layout.replace("@", body))
                    kept[kind] += [w in text.split("\n\n") or w in text for w in want]
                    leaks += [w for w in text.split() if w.startswith("Z")]
    return kept, leaks


@pytest.mark.parametrize("kind", BLOCKS)
def test_recall_by_kind_of_block(results, kind):
    kept = results[0][kind]
    assert sum(kept) >= 0.99 * len(kept)


def test_clutter_stays_out(results):
    assert not results[1]
