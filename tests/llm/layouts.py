"""Pages laid out by hand, none from the generator that the extractor learns from, with the text that belongs to the article."""

P1 = "The harbour council met on Monday to decide whether the old lighthouse should be repaired before the winter storms arrive."
P2 = "Engineers who inspected the tower said that its foundations were sound, but the lantern room would need new glass and iron."
P3 = "Residents asked for more time to raise money, and the council agreed to vote again in the second week of November."
P4 = "A small museum in the keeper's cottage will stay open while the work goes on, its director said after the meeting."
H = "Lighthouse vote is put off"
MENU = '<a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a> <a href="/about">About us</a>'
LIST = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/contact">Contact</a></li></ul>'
RIGHTS = "&copy; 2024 Harbour Gazette. All rights reserved."
RELATED = '<h3>Related</h3><ul><li><a href="/1">Storm damages the pier</a></li><li><a href="/2">Ferry times change</a></li><li><a href="/3">New mayor sworn in</a></li></ul>'
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = "\n".join([P1, P2, P3])
FULL = "\n".join([H, P1, P2, P3])


def page(body: str, head: str = "<title>Harbour Gazette</title>") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


#: name -> (page, text)
LAYOUTS = {
    "divs only": (page(f"<div>{MENU}</div><div><h1>{H}</h1>{BODY}</div><div>{RIGHTS}</div>"), FULL),
    "divs with ids": (page(f'<div id="nav">{LIST}</div><div id="content"><h1>{H}</h1>{BODY}</div><div id="footer"><p>{RIGHTS}</p></div>'), FULL),
    "table": (page(f'<table width="100%"><tr><td>{LIST}</td><td><h1>{H}</h1>{BODY}</td></tr><tr><td colspan="2">{RIGHTS}</td></tr></table>'), FULL),
    "table with menu row": (page(f"<table><tr><td>{MENU}</td></tr><tr><td><h2>{H}</h2>{BODY}</td></tr><tr><td>{RIGHTS}</td></tr></table>"), FULL),
    "semantic": (page(f"<header><p>Harbour Gazette</p></header><nav>{LIST}</nav><main><article><h1>{H}</h1>{BODY}</article></main><footer>{RIGHTS}</footer>"), FULL),
    "header in the article": (page(f"<nav>{MENU}</nav><article><header><h1>{H}</h1><p>By A. Reporter</p></header>{BODY}</article><footer>{RIGHTS}</footer>"), TEXT),
    "article alone": (page(f"<article><h1>{H}</h1>{BODY}</article>"), FULL),
    "no markup around": (page(f"<h1>{H}</h1>{BODY}"), FULL),
    "comments by name": (page(f'<article><h1>{H}</h1>{BODY}</article><section id="comments"><h2>3 comments</h2><div class="comment"><b>Ann</b><p>I never liked that tower anyway.</p></div><div class="comment"><b>Bo</b><p>Save it, please!</p></div></section>'), FULL),
    "comments without a known name": (page(f'<div class="story"><h1>{H}</h1>{BODY}</div><div class="talkback"><h3>What readers say</h3><div><b>Ann</b><p>I never liked that tower anyway.</p></div><div><b>Bo</b><p>Save it, please!</p></div><div><b>Cy</b><p>Money is better spent on the school roof.</p></div></div>'), FULL),
    "comments in a list": (page(f'<main><h1>{H}</h1>{BODY}</main><ol class="replies"><li><cite>Ann</cite><p>Nice to read this.</p></li><li><cite>Bo</cite><p>It is about time they did something.</p></li></ol>'), FULL),
    "comments inside the article": (page(f'<article><h1>{H}</h1>{BODY}<div class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>First!</p></div><div class="comment"><b>Bo</b><p>They should keep it.</p></div></div></article>'), FULL),
    "sidebar": (page(f'<nav>{MENU}</nav><div class="content"><h1>{H}</h1>{BODY}</div><aside>{RELATED}</aside><footer>{RIGHTS}</footer>'), FULL),
    "sidebar first": (page(f'<div class="sidebar">{RELATED}</div><div class="post"><h1>{H}</h1>{BODY}</div>'), FULL),
    "cookie notice": (page(f'<div class="cookie-banner"><p>We use cookies to make this site work.</p><button>Accept</button></div><article><h1>{H}</h1>{BODY}</article>'), FULL),
    "newsletter in the article": (page(f'<article><h1>{H}</h1><p>{P1}</p><form><label>Get our letter</label><input type="email"><button>Subscribe</button></form><p>{P2}</p><p>{P3}</p></article>'), FULL),
    "advert in the article": (page(f'<article><h1>{H}</h1><p>{P1}</p><div class="ad">Buy two kettles and pay for one</div><p>{P2}</p><p>{P3}</p></article><footer>{RIGHTS}</footer>'), FULL),
    "advert by a long name": (page(f'<article><h1>{H}</h1><p>{P1}</p><div class="advertisement box"><p>Buy two kettles</p></div><p>{P2}</p><p>{P3}</p></article>'), FULL),
    "scripts and styles": (page(f"<style>p {{ color: red }}</style><script>var x = '<p>not this</p>';</script><article><h1>{H}</h1>{BODY}<script>track();</script></article>"), FULL),
    "inline markup": (page(f'<article><h1>{H}</h1><p>{P1[:20]}<b>{P1[20:40]}</b>{P1[40:]}</p><p><em>{P2}</em></p><p>{P3}</p></article>'), FULL),
    "character references": (page("<article><h1>Fish &amp; chips</h1><p>Caf&eacute; prices rose &mdash; by 5&nbsp;%, owners said &lt;again&gt; this week.</p></article>"), "Fish & chips\nCafé prices rose — by 5 %, owners said <again> this week."),
    "unclosed paragraphs": (page(f"<nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}<p>{P2}<p>{P3}</article><footer>{RIGHTS}</footer>"), FULL),
    "lists in the article": (page(f"<nav>{LIST}</nav><article><h1>{H}</h1><p>{P1}</p><ul><li>New glass for the lantern room</li><li>Iron for the gallery</li></ul><p>{P2}</p></article>"), "\n".join([H, P1, "New glass for the lantern room", "Iron for the gallery", P2])),
    "table in the article": (page(f"<nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><table><tr><td>Glass</td><td>4,000</td></tr><tr><td>Iron</td><td>9,500</td></tr></table><p>{P2}</p></article>"), "\n".join([H, P1, "Glass", "4,000", "Iron", "9,500", P2])),
    "sections": (page(f'<header><a href="/">Gazette</a></header><main><section><h1>{H}</h1><p>{P1}</p></section><section><h2>What comes next</h2><p>{P3}</p><p>{P4}</p></section></main><footer><p>{RIGHTS}</p></footer>'), "\n".join([H, P1, "What comes next", P3, P4])),
    "deep wrappers": (page(f'<div class="wrapper"><div class="inner"><div class="menu">{LIST}</div><div class="row"><div class="col"><div class="entry-content"><h1>{H}</h1>{BODY}</div></div></div></div></div>'), FULL),
    "long footer": (page(f'<article><h1>{H}</h1>{BODY}</article><footer><p>Harbour Gazette is published daily by the Harbour Press, and its editors answer every letter that readers send to the old office on the quay.</p><p>{RIGHTS}</p></footer>'), FULL),
    "quote": (page(f"<nav>{MENU}</nav><article><h1>{H}</h1><p>{P1}</p><blockquote>{P4}</blockquote><p>{P3}</p></article>"), "\n".join([H, P1, P4, P3])),
}
