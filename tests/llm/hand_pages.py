"""Pages written by hand, of other make than the teacher's: (html, the words of its main text)."""

PAGES = [
    ("""<html><body><div class=topbar>Welcome to our site</div><h1>Annual report</h1><pre>total 12
drwx 3 root</pre><table><tr><th>Year</th><th>Sales</th></tr><tr><td>2001</td><td>12</td></tr><tr><td>2002</td><td>15</td></tr></table><p>Closing remarks follow here.</p><div class=footer>(c) 2002 Example Ltd. All rights reserved.</div></body></html>""",
     "Annual report total 12 drwx 3 root Year Sales 2001 12 2002 15 Closing remarks follow here."),
    ("""<!doctype html><html><head><title>Soup</title></head><body><header><a href="/">Kitchen</a><nav><a href="/a">Starters</a> <a href="/b">Mains</a> <a href="/c">Desserts</a></nav></header><main><h1>Leek soup</h1><p>A plain soup for cold evenings, ready in half an hour.</p><h2>Ingredients</h2><ul><li>3 leeks</li><li>2 potatoes</li><li>1 litre of stock</li></ul><h2>Method</h2><ol><li>Wash and slice the leeks.</li><li>Boil everything until soft.</li></ol></main><footer><p>Contact | Imprint</p></footer></body></html>""",
     "Leek soup A plain soup for cold evenings, ready in half an hour. Ingredients 3 leeks 2 potatoes 1 litre of stock Method Wash and slice the leeks. Boil everything until soft."),
    ("""<html><body><div id="wrapper"><div id="nav-main"><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/sport>Sport</a></li></ul></div><div id="story"><h1>Bridge closed for repairs</h1><div class="byline">By our reporter</div><p>The old bridge over the river will stay closed until spring, the council said on Monday.</p><p>Engineers found cracks in two of its piers.</p><figure><img src=x.jpg><figcaption>The bridge in winter.</figcaption></figure><p>Buses take the northern route.</p></div><div class="related-links"><h4>Read also</h4><ul><li><a href=/x>Ferry timetable changes</a></li><li><a href=/y>New cycle path opens</a></li></ul></div></div></body></html>""",
     "Bridge closed for repairs By our reporter The old bridge over the river will stay closed until spring, the council said on Monday. Engineers found cracks in two of its piers. The bridge in winter. Buses take the northern route."),
    ("""<body><table width=100%><tr><td class="menu"><a href=1>Start</a><br><a href=2>About</a><br><a href=3>Links</a></td><td><h2>My garden diary</h2><p>In March I sowed peas and broad beans under glass.</p><p>By May the first pods could be picked, and the beans were in flower.</p></td></tr></table></body>""",
     "My garden diary In March I sowed peas and broad beans under glass. By May the first pods could be picked, and the beans were in flower."),
    ("""<html><body><div class="cookie-consent"><p>We use cookies to improve your experience.</p><button>Accept all</button></div><article><h1>How tides work</h1><p>The moon pulls at the oceans, and so does the sun, if less.</p><blockquote>Twice a day the sea comes in.</blockquote><p>Where coasts narrow, the range can exceed ten metres.</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>Great explanation, thanks!</p></div><div class="comment"><p>What about lakes?</p></div></section></body></html>""",
     "How tides work The moon pulls at the oceans, and so does the sun, if less. Twice a day the sea comes in. Where coasts narrow, the range can exceed ten metres."),
    ("""<html><body><nav class="breadcrumbs"><a href=/>Docs</a> &gt; <a href=/api>API</a> &gt; Install</nav><main class="doc"><h1>Install</h1><p>Unpack the archive and run the script.</p><pre><code>./configure --prefix=/opt
make install</code></pre><h2>Options</h2><dl><dt>--prefix</dt><dd>Where files go.</dd><dt>--quiet</dt><dd>Print less.</dd></dl></main><aside class="toc"><ul><li><a href=#1>Install</a></li><li><a href=#2>Options</a></li></ul></aside></body></html>""",
     "Install Unpack the archive and run the script. ./configure --prefix=/opt make install Options --prefix Where files go. --quiet Print less."),
    ("""<html><body><div class="masthead"><h2>The Daily Example</h2></div><div class="ad-slot">Advertisement</div><div class="post"><h1>Ein Tag im Museum</h1><p>Am Sonntag war der Eintritt frei, und vor dem Tor stand eine lange Schlange.</p><p>Drinnen hingen alte Karten der Stadt.</p></div><div class="newsletter-box"><p>Abonnieren Sie unseren Newsletter!</p><form><input name=mail><button>Anmelden</button></form></div><footer>Impressum Datenschutz</footer></body></html>""",
     "Ein Tag im Museum Am Sonntag war der Eintritt frei, und vor dem Tor stand eine lange Schlange. Drinnen hingen alte Karten der Stadt."),
    ("""<html><body><ul class="nav"><li><a href=/>Accueil</a></li><li><a href=/r>Recettes</a></li></ul><div class="content"><h1>Tarte aux pommes</h1><p>Une recette simple que ma grand-mère faisait chaque automne.</p><p>Étalez la pâte, disposez les pommes et enfournez trente minutes.</p></div><div class="sidebar"><h3>Catégories</h3><ul><li><a href=/d>Desserts</a></li><li><a href=/p>Plats</a></li></ul></div></body></html>""",
     "Tarte aux pommes Une recette simple que ma grand-mère faisait chaque automne. Étalez la pâte, disposez les pommes et enfournez trente minutes."),
    ("""<html><body><div class="hero"><h1>Release 4.2</h1></div><div class="notes"><p>This release mends three faults.</p><ul><li>Saving no longer drops the last line.</li><li>Search finds accents.</li><li>Printing works on paper of any size.</li></ul><p>Thanks to all who reported them.</p></div><div class="copyright">Copyright 2020 Example</div></body></html>""",
     "Release 4.2 This release mends three faults. Saving no longer drops the last line. Search finds accents. Printing works on paper of any size. Thanks to all who reported them."),
    ("""<html><body><div id=hd><form action=/search><label>Search</label><input><button>Go</button></form></div><div id=bd><h1>Opening hours</h1><table><tr><td>Monday</td><td>9 to 17</td></tr><tr><td>Tuesday</td><td>9 to 17</td></tr><tr><td>Sunday</td><td>closed</td></tr></table><p>On public holidays the library is closed all day.</p></div><div id=ft><p>&copy; City Library</p></div></body></html>""",
     "Opening hours Monday 9 to 17 Tuesday 9 to 17 Sunday closed On public holidays the library is closed all day."),
    ("""<html><body><article class="entry"><h2>Walking the ridge</h2><p>We left before dawn.</p><p>Fog lay in the valley and the path was wet with dew; only the tops of the pines stood out.</p><p>At noon we ate.</p><p>The way down took longer than the map had promised.</p></article><div class="pager"><a href=/p>Older</a> <a href=/n>Newer</a></div></body></html>""",
     "Walking the ridge We left before dawn. Fog lay in the valley and the path was wet with dew; only the tops of the pines stood out. At noon we ate. The way down took longer than the map had promised."),
    ("""<html><body><div class="alert">Service will be down on Friday night.</div><div class="main-column"><h1>Questions and answers</h1><h3>Can I return an item?</h3><p>Yes, within thirty days, in its box.</p><h3>Who pays for the parcel?</h3><p>We do, if the item is faulty.</p></div><div class="social">Follow us: <a href=#>one</a> <a href=#>two</a></div></body></html>""",
     "Questions and answers Can I return an item? Yes, within thirty days, in its box. Who pays for the parcel? We do, if the item is faulty."),
    ("""<html><body><header><h1>Weather station</h1></header><section class="report"><h2>Tuesday</h2><p>Rain in the morning, dry later, with a fresh wind from the west.</p><h2>Wednesday</h2><p>Sunny spells and showers.</p></section><footer><small>Data without warranty.</small></footer></body></html>""",
     "Tuesday Rain in the morning, dry later, with a fresh wind from the west. Wednesday Sunny spells and showers."),
    ("""<html><body><div class="left"><a href=/1>Fractions</a><a href=/2>Decimals</a><a href=/3>Percent</a></div><div class="lesson"><h1>Adding fractions</h1><p>Bring both to one denominator.</p><pre>1/2 + 1/3 = 3/6 + 2/6 = 5/6</pre><p>Then add the numerators, and shorten if you can.</p></div></body></html>""",
     "Adding fractions Bring both to one denominator. 1/2 + 1/3 = 3/6 + 2/6 = 5/6 Then add the numerators, and shorten if you can."),
    ("""<html><body><div class="promo-banner"><p>Save 20% this week only!</p></div><div itemprop="articleBody"><p>Bees dance to tell their sisters where flowers are. The angle of the dance gives the direction, its length the distance.</p><p>Karl von Frisch found this out in the forties.</p></div><div class="share"><a href=#>Share</a><a href=#>Print</a></div><div class="tags"><a href=/t1>bees</a> <a href=/t2>insects</a></div></body></html>""",
     "Bees dance to tell their sisters where flowers are. The angle of the dance gives the direction, its length the distance. Karl von Frisch found this out in the forties."),
    ("""<html><body><div class="container"><div class="row"><div class="col-8"><h1>El mercado</h1><p>Los sábados el mercado ocupa toda la plaza, desde la iglesia hasta el puente.</p><p>Hay quesos, aceitunas y miel de la sierra.</p></div><div class="col-4"><h4>Lo más leído</h4><ol><li><a href=/1>La feria de mayo</a></li><li><a href=/2>Obras en el puente</a></li></ol></div></div></div></body></html>""",
     "El mercado Los sábados el mercado ocupa toda la plaza, desde la iglesia hasta el puente. Hay quesos, aceitunas y miel de la sierra."),
    ("""<html><body><div class="page"><h1>Minutes of the meeting</h1><dl><dt>Present</dt><dd>Five members</dd><dt>Place</dt><dd>Town hall</dd></dl><p>The budget was passed without dissent.</p><p>Next meeting in June.</p></div><div class="legal-notice"><p>All statements without liability.</p></div></body></html>""",
     "Minutes of the meeting Present Five members Place Town hall The budget was passed without dissent. Next meeting in June."),
    ("""<html><body><nav><ul><li><a href=/>Index</a></li></ul></nav><article><h1>Chapter one</h1>""" + "".join(f"<p>Paragraph {i} goes on for a while about nothing in particular, as such paragraphs do.</p>" for i in range(40)) + """</article><footer>End of page</footer></body></html>""",
     "Chapter one " + " ".join(f"Paragraph {i} goes on for a while about nothing in particular, as such paragraphs do." for i in range(40))),
    ("""<html><body><h1>Plain page</h1><p>Written in nineteen ninety-six, with no style at all.</p><hr><p>It has two paragraphs.</p><address>webmaster@example.org</address></body></html>""", "Plain page Written in nineteen ninety-six, with no style at all. It has two paragraphs."),
    ("""<html><body><div class="modal" style="display:none"><p>Log in to continue</p></div><div class="reader"><h1>The lighthouse</h1><p>It stood on the rock for a hundred years before the lamp went out.</p><div class="ad"><p>Buy lamps here</p></div><p>Now gulls nest on its gallery.</p></div><div class="discussion"><p>Nice story.</p></div></body></html>""",
     "The lighthouse It stood on the rock for a hundred years before the lamp went out. Now gulls nest on its gallery."),
]
