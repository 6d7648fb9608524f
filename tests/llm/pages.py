"""Pages written by hand, unlike the generated ones, with the blocks of their articles."""

PAGES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Bridge reopens | The Valley Courier</title><style>body{margin:0}</style><script>var a = "<p>no</p>";</script></head>
<body class="home"><a href="#main" class="skip-link">Skip to content</a><div id="cookie-banner" role="dialog"><p>We value your privacy. We and our partners store cookies on your device.</p><button>Accept all</button></div>
<header class="site-header"><a href="/" class="logo">The Valley Courier</a><nav><ul><li><a href="/local">Local</a></li><li><a href="/sports">Sports</a></li><li><a href="/opinion">Opinion</a></li></ul></nav></header>
<main id="main"><article><h1>Old stone bridge reopens after two years of repairs</h1><p>Residents of the lower valley crossed the old stone bridge on foot this Saturday for the first time since the flood of 2021 tore away its western arch.</p>
<p>The county spent 3.2 million on the work, which took eight months longer than planned because masons had to quarry matching limestone by hand.</p><svg width="10" height="10"/><h2>A slow restoration</h2>
<p>&ldquo;We could have poured concrete in a summer,&rdquo; said the county engineer, &ldquo;but nobody would have thanked us for it.&rdquo;</p><ul><li>New lamps along the parapet</li><li>A lane for bicycles</li></ul></article>
<aside class="related-stories"><h3>Related</h3><ul><li><a href="/1">Flood defences to be raised</a></li><li><a href="/2">Mill museum seeks volunteers</a></li></ul></aside>
<section id="comments"><h3>3 comments</h3><div class="comment"><b>anna_k</b><p>So happy to see it open again, well done everyone!</p></div></section></main>
<footer><p>&copy; 2024 The Valley Courier. All rights reserved.</p><a href="/privacy">Privacy policy</a></footer></body></html>""",
        ["Old stone bridge reopens after two years of repairs", "Residents of the lower valley crossed the old stone bridge on foot this Saturday for the first time since the flood of 2021 tore away its western arch.", "The county spent 3.2 million on the work, which took eight months longer than planned because masons had to quarry matching limestone by hand.", "A slow restoration", "“We could have poured concrete in a summer,” said the county engineer, “but nobody would have thanked us for it.”", "New lamps along the parapet", "A lane for bicycles"],
    ),
    (
        """<html><body><div id="wrap"><div id="top"><h1><a href="/">Notes on gardening</a></h1></div><div id="menu"><a href="/">Home</a> | <a href="/archive">Archive</a> | <a href="/about">About me</a></div>
<div class="post"><h2>How I keep slugs away from lettuce</h2><p class="meta">Posted by Ruth on 4 May</p><div class="entry"><p>Every spring I lose half of my seedlings to slugs, and every spring I try something new.<br>This year it was copper tape around the raised beds.</p>
<p>It worked far better than eggshells ever did. The tape costs little, lasts for years and does no harm to hedgehogs.</p><blockquote>A hungry slug will climb almost anything, but it does not like copper.</blockquote><p>Next week I shall write about beans.</p></div></div>
<div id="sidebar"><h3>Categories</h3><ul><li><a href="/c/1">Vegetables</a></li><li><a href="/c/2">Flowers</a></li></ul><h3>Blogroll</h3><ul><li><a href="http://x/">Tom's allotment</a></li></ul></div>
<div id="footer">Powered by a small blog engine. Theme by nobody.</div></div></body></html>""",
        ["How I keep slugs away from lettuce", "Every spring I lose half of my seedlings to slugs, and every spring I try something new. This year it was copper tape around the raised beds.", "It worked far better than eggshells ever did. The tape costs little, lasts for years and does no harm to hedgehogs.", "A hungry slug will climb almost anything, but it does not like copper.", "Next week I shall write about beans."],
    ),
    (
        """<html><body><div class="navbar navbar-default"><ul class="nav"><li><a href="a">Docs</a><li><a href="b">Download</a><li><a href="c">Community</a></ul></div><div class="container"><div class="row"><div class="col-md-9 content">
<h1>Installing the compiler</h1><p>The compiler runs on all common systems and needs about two gigabytes of disk space.</p><h2>From source</h2><p>Clone the repository, then run the build script in the top folder. The first build takes up to an hour.</p>
<pre>git clone example
make install</pre><p>If the build stops with an error about missing headers, install the development files of your system first.</p><table><tr><th>System</th><th>Package</th></tr><tr><td>Debian</td><td>build-essential</td></tr></table></div>
<div class="col-md-3 sidebar"><p><a href="x">On this page</a></p><ul><li><a href="#1">From source</a></li></ul></div></div></div><form class="newsletter"><label>Get release news by e-mail</label><input name="e"><button>Subscribe</button></form><div class="footer"><p>Licensed under a free licence. <a href="i">Imprint</a></p></div></body></html>""",
        ["Installing the compiler", "The compiler runs on all common systems and needs about two gigabytes of disk space.", "From source", "Clone the repository, then run the build script in the top folder. The first build takes up to an hour.", "git clone example make install", "If the build stops with an error about missing headers, install the development files of your system first.", "System", "Package", "Debian", "build-essential"],
    ),
    (
        """<html><body><table width="100%"><tr><td class="menu"><a href="1">Start</a><br><a href="2">Geschichte</a><br><a href="3">Anfahrt</a></td><td class="inhalt"><h2>Die Geschichte der Mühle</h2><p>Die Mühle am Bach wurde im Jahr 1734 erbaut und gehörte lange Zeit dem Kloster.</p><p>Nach dem großen Brand von 1811 kaufte sie ein Müller aus dem Nachbardorf, der sie mit eigener Hand wieder aufbaute.
<p>Heute mahlt sie nur noch zu besonderen Anlässen, doch das Wasserrad dreht sich das ganze Jahr.</td></tr></table><div class="impressum">Impressum | Datenschutz | Kontakt</div></body></html>""",
        ["Die Geschichte der Mühle", "Die Mühle am Bach wurde im Jahr 1734 erbaut und gehörte lange Zeit dem Kloster.", "Nach dem großen Brand von 1811 kaufte sie ein Müller aus dem Nachbardorf, der sie mit eigener Hand wieder aufbaute.", "Heute mahlt sie nur noch zu besonderen Anlässen, doch das Wasserrad dreht sich das ganze Jahr."],
    ),
    (
        """<html><body><div class="ad-slot"><p>Advertisement</p><a href="z">Buy two, get one free! Limited offer, free shipping on all orders.</a></div><section class="story"><header><h1>Why octopuses dream</h1></header><p>For a few seconds the sleeping animal flushes dark, then pale, then speckled, as though it were hunting on a reef.</p>
<div class="ad"><p>Sponsored: the softest pillows in the country, now at half price.</p></div><p>Researchers who filmed dozens of nights believe that these displays replay events of the day.</p><p>Proof is hard to come by, since no octopus has yet been willing to describe what it saw.</p><figure><img src="o.jpg"><figcaption>An octopus asleep in its den.</figcaption></figure></section>
<div class="share-buttons"><a href="f">Share</a> <a href="t">Tweet</a></div><div class="newsletter-signup"><p>Enjoyed this? Subscribe to our weekly letter.</p></div><div class="disqus-thread"><p class="c">marine_mike: my dog does the same thing lol</p></div></body></html>""",
        ["Why octopuses dream", "For a few seconds the sleeping animal flushes dark, then pale, then speckled, as though it were hunting on a reef.", "Researchers who filmed dozens of nights believe that these displays replay events of the day.", "Proof is hard to come by, since no octopus has yet been willing to describe what it saw.", "An octopus asleep in its den."],
    ),
]
