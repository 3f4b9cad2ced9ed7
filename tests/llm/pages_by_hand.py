"""Pages of layouts unlike the drawn ones: html, and the main text that a reader would take from it."""

P1 = "The river rose by three metres overnight, and the old bridge was closed to all traffic before dawn."
P2 = "Engineers said on Tuesday that the pillars would be inspected by divers as soon as the water falls."
P3 = "Nobody was hurt; the school on the east bank stays closed until Friday."

PAGES = {
    "semantic": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><a href='/'>River Post</a><nav><a href=/a>News</a> <a href=/b>Sport</a></nav></header><main><article><h1>Bridge closed after flood</h1><p>{P1}</p><p>{P2}<script>x()</script></p><p>{P3}</p></article></main><aside><h2>Most read</h2><ul><li><a href=/1>Ten pies to try</a><li><a href=/2>Who won the cup</a></ul></aside><footer><p>&copy; 2024 River Post. All rights reserved.</p></footer></body></html>",
        f"Bridge closed after flood\n{P1}\n{P2}\n{P3}",
    ),
    "classes": (
        f"<div id='wrap'><div class='siteHeader'><div class='logo'>River Post</div><ul class='mainNav'><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></div><div class='cookie-consent'>We use cookies to make this site work. <button>Accept</button></div><div class='postContent'><h2>Bridge closed &amp; guarded</h2><p>{P1}</p><div class='advertBox'><p>Buy boots at half price today!</p></div><p>{P2}</p></div><div class='sidebarRight'><h3>Latest</h3><p>Read how the town prepares for the winter season this year.</p></div><div id='comments'><h3>2 comments</h3><div class='comment'><b>Ann</b><p>I crossed it only an hour before, what luck that was.</p></div><div class='comment'><b>Joe</b><p>They should have closed it years ago, as I always said.</p></div><form><label>Name</label><input><button>Send</button></form></div><div class='siteFooter'>Imprint | Privacy</div></div>",
        f"Bridge closed & guarded\n{P1}\n{P2}",
    ),
    "both": (
        f"<body class=home><nav class=breadcrumbs><a href=/>Home</a> &gt; <a href=/n>News</a></nav><section class='article-body'><h1>Flood</h1><p>{P1}<br>{P3}</p><ul><li>Bridge: closed</li><li>Road 9: open</li></ul><blockquote>{P2}</blockquote></section><section class='newsletter-signup'><h3>Get our letter</h3><p>Sign up and read the news each morning.</p><form><input type=email></form></section><section class='related-stories'><h3>More stories</h3><p>Why rivers rise faster than they did a century ago.</p></section><footer class=bottom><a href=/c>Contact</a></footer>",
        f"Flood\n{P1} {P3}\nBridge: closed\nRoad 9: open\n{P2}",
    ),
    "plain": (f"<p>{P1}<p>{P2}<p>{P3}", f"{P1}\n{P2}\n{P3}"),
    "text alone": (f"{P1} {P2}", f"{P1} {P2}"),
    "comments as articles": (
        f"<main><article class=story><h1>Flood</h1><p>{P1}</p><p>{P2}</p></article><section class='reader-comments'><h2>Readers write</h2><article class=comment><p>{P3}</p></article><article class=comment><p>We walked home over the hills and it took the whole night.</p></article></section></main><footer>Terms of use</footer>",
        f"Flood\n{P1}\n{P2}",
    ),
    "notices": (
        f"<div role=alert class='notice'>Breaking news: the train is late.</div><header><h1>River Post</h1><form class=search><label>Search</label><input></form></header><article><h1>Flood</h1><div class=share-buttons><a href=x>Share</a> <a href=y>Tweet</a></div><p>{P1}</p><figure><img src=a.png><figcaption>The bridge at dawn.</figcaption></figure><p>{P2}</p></article><div class='ad-slot'>Advertisement</div><div hidden class=modal>Subscribe to continue reading.</div><footer>© River Post</footer>",
        f"Flood\n{P1}\nThe bridge at dawn.\n{P2}",
    ),
    "nothing": ("<nav><a href=/a>News</a><a href=/b>Sport</a></nav><footer>© River Post</footer>", ""),
    "empty": ("", ""),
}
