"""Pages written by hand in layouts that the training templates don't know. What stands between the marks
[[ and ]] was labelled as main text; the marks are taken out before extraction."""

PAGES = {
    "blog": """<!doctype html><html><head><title>Baking rye bread | The Crumb</title></head><body class="post-template-default single single-post">
<div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<div id="top" class="site-header"><div class="branding"><p class="site-title"><a href="/">The Crumb</a></p><p>Notes from a small kitchen</p></div>
<ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li></ul></div>
<div id="primary"><article id="post-311"><h1 class="entry-title">[[Baking rye bread without a mixer]]</h1>
<div class="entry-content"><p>[[Rye has little gluten, so kneading it for long is wasted work. What it wants is time, water and a warm corner of the kitchen.]]</p>
<p>[[Start the evening before. Stir <em>two spoons</em> of sourdough into the flour, add the water and cover the bowl.]]</p>
<h2>[[What you need]]</h2><ul><li>[[500 g of dark rye flour]]</li><li>[[420 ml of lukewarm water]]</li><li>[[10 g of salt]]</li></ul>
<p>[[By the next morning the dough should have risen by half. Put it in a tin, wait another hour, and bake it for fifty minutes.]]</p>
<div class="wp-block-image"><figure><img src="b.jpg"><figcaption>[[The loaf needs a day before it is cut.]]</figcaption></figure></div></div></article>
<div id="comments" class="comments-area"><h2>Three thoughts on this</h2><ol><li class="comment"><p>Mine came out far too wet, I used less water the second time.</p></li><li class="comment"><p>Lovely, thank you. Does it freeze well?</p></li></ol></div></div>
<div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Oat biscuits</a></li><li><a href="/2">A week of soup</a></li></ul></div>
<div id="colophon" class="site-footer"><p>Made with care. All rights reserved.</p></div></div></body></html>""",
    "news": """<html><body><header class="global"><div class="logo"><a href="/">Harbour Gazette</a></div><nav><a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></nav></header>
<div class="cookie-banner"><p>We and our partners store information on your device. You can change your choice at any time.</p><button>Accept</button></div>
<main><div class="story-grid"><div class="story-column"><p class="kicker">[[Town council]]</p><h1>[[Old ferry to sail again after nine years]]</h1><p class="byline">[[By Ada Holm]]</p>
<p>[[The council voted on Tuesday to return the old ferry to the harbour route. It last sailed nine years ago, when its boiler failed an inspection.]]</p>
<div class="ad-slot"><p>Advertisement</p></div>
<p>[[Repairs will take until spring. The engineer in charge, who has worked on three such ships, called the hull sound and the engine tired.]]</p>
<blockquote>[[We are not building a museum. People will use it to get to work.]]</blockquote>
<p>[[Tickets are to cost the same as the bus. A second vote, on the pier, is planned for June.]]</p>
<div class="newsletter-signup"><h3>Get the morning briefing</h3><p>Five stories every day before breakfast.</p><form><input name="mail"><button>Sign up</button></form></div></div>
<aside class="rail"><h2>Most read</h2><ol><li><a href="/a">Bakery closes after a century</a></li><li><a href="/b">Rain expected all weekend</a></li><li><a href="/c">New head teacher named</a></li></ol></aside></div></main>
<footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p>Harbour Gazette is printed in town since 1881.</p></footer></body></html>""",
    "tables": """<HTML><BODY BGCOLOR=white><CENTER><TABLE WIDTH=760 BORDER=0><TR><TD COLSPAN=2><FONT SIZE=5><B>Radio Workshop</B></FONT></TD></TR>
<TR><TD WIDTH=140 VALIGN=top><A HREF=index.html>Start</A><BR><A HREF=kits.html>Kits</A><BR><A HREF=mail.html>Write to me</A><BR><A HREF=links.html>Links</A></TD>
<TD VALIGN=top><H2>[[A receiver with one valve]]</H2>[[This set was built from parts that came out of a drawer. It receives the medium wave after dark and needs a long wire as an aerial.]]<P>[[The coil is wound on a cardboard tube. Sixty turns are enough, and a tap at the tenth turn feeds the valve.]]<P>[[Be careful with the anode battery: ninety volts can hurt. Switch it off before you touch the coil.]]
<P>[[If the set howls, turn the reaction back until it stops.]]</TD></TR>
<TR><TD COLSPAN=2><HR><FONT SIZE=1>Last changed in May. You are visitor 10423.</FONT></TD></TR></TABLE></CENTER></BODY></HTML>""",
    "wiki": """<html><body><div id="mw-navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li><li><a href="/h">Help</a></li></ul></div>
<div id="content" role="main"><h1 id="firstHeading">[[Salt marsh]]</h1><div id="bodyContent"><div id="mw-content-text"><p>[[A <b>salt marsh</b> is a coastal meadow that the <a href="/tide">tide</a> floods and drains. It lies between land and open <a href="/sea">salt water</a>.]]</p>
<table class="infobox"><tr><th>[[Soil]]</th><td>[[Mud and peat]]</td></tr><tr><th>[[Plants]]</th><td>[[Grasses, herbs, low shrubs]]</td></tr></table>
<h2>[[Formation]]</h2><p>[[Marshes form where waves are weak and rivers bring fine sediment. Plants that bear salt hold the mud, and the ground rises year by year.]]</p>
<p>[[Creeks cut through the surface. At low water they are dry, and at spring tides the whole marsh is under water.]]</p>
<h2>[[Use]]</h2><ul><li>[[Grazing by sheep and cattle]]</li><li>[[Protection of dikes against waves]]</li></ul></div></div></div>
<div id="footer"><ul><li>This page was last edited on 3 March.</li><li>Text is available under a free licence.</li></ul></div></body></html>""",
    "documentation": """<html><body><div class="topbar"><a href="/">libqueue</a><input placeholder="Search"></div><div class="layout"><div class="sidebar-tree"><ul><li><a href="/i">Install</a></li><li><a href="/q">Quick start</a></li><li><a href="/a">Reference</a></li></ul></div>
<div class="document" role="main"><div class="section"><h1>[[Quick start]]</h1><p>[[A queue holds items until a worker takes them. Items are kept on disk, so a restart loses nothing.]]</p>
<pre>[[q = Queue("mail")
q.put("hello")]]</pre><p>[[Calling <code>put</code> returns at once. The item is written in the background within a second.]]</p>
<div class="section"><h2>[[Workers]]</h2><p>[[Start as many workers as you like. Each item goes to one of them, and goes back if that worker dies.]]</p><pre>[[for item in q:
    handle(item)]]</pre></div></div></div></div>
<div class="prev-next pager"><a href="/i">Previous: Install</a> <a href="/a">Next: Reference</a></div><div class="footer">Built from the sources of version 2.1.</div></body></html>""",
    "plain": """<html><body><h1>[[How the clock was mended]]</h1><p>[[The church clock stood still for a summer. Nobody in the village knew how to climb to it, and the ladder was gone.]]</p><p>[[In September a boy found the ladder in a barn. The smith cut a new tooth for the third wheel, and on a Sunday it struck nine.]]</p><p>[[It has been four minutes slow ever since.]]</p></body></html>""",
    "german": """<html lang="de"><body><nav class="hauptmenue"><ul><li><a href="/">Start</a></li><li><a href="/v">Verein</a></li><li><a href="/t">Termine</a></li></ul></nav><section class="seite"><div class="spalte-links"><h1>[[Wanderung zur Quelle]]</h1><p>[[Am Samstag gehen wir zur Quelle am Waldrand. Treffpunkt ist um neun Uhr am Bahnhof, festes Schuhwerk ist n&ouml;tig.]]</p><p>[[Der Weg ist zw&ouml;lf Kilometer lang und steigt langsam an. Eine Rast ist auf der halben Strecke geplant.]]</p><p>[[Bei Gewitter f&auml;llt die Wanderung aus.]]</p></div><aside><h3>N&auml;chste Termine</h3><ul><li><a href="/1">Chorprobe</a></li><li><a href="/2">Sommerfest</a></li></ul></aside></section><footer><p>Impressum und Datenschutz</p></footer></body></html>""",
    "shop help": """<html><body><div class="header-wrap"><div class="search-box"><form><label>Search the help</label><input></form></div><div class="login"><a href="/l">Log in</a></div></div>
<div class="breadcrumbs"><a href="/">Help</a> / <a href="/r">Returns</a></div><div class="container"><div class="col-8"><div class="article-body"><h1>[[Sending a parcel back]]</h1><p>[[You can return anything within thirty days. The label is in the box; if it is missing, we send you another one.]]</p><h3>[[Steps]]</h3><ol><li>[[Pack the goods in the box they came in.]]</li><li>[[Put the label over the old address.]]</li><li>[[Hand the parcel in at any post office.]]</li></ol><p>[[The money is paid back within a week after the parcel has reached us.]]</p></div>
<div class="share-buttons"><a href="/f">Share</a> <a href="/m">Mail</a></div></div><div class="col-4"><div class="related-articles"><h4>Related</h4><ul><li><a href="/1">Changing an order</a></li><li><a href="/2">Lost parcels</a></li></ul></div></div></div>
<div class="legal-footer"><p>Prices include tax. Pictures may differ from the goods.</p></div></body></html>""",
}
