"""The small labelled table that the block classifier learns from: pages whose article blocks bear ``data-main``."""

# Hand-made pages of common layouts. Nothing but the training reads the attribute data-main.
PAGES = [
    """<body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a><li><a href=/n>Latest news</a></ul></nav>
    <article><h1 data-main>A short title</h1><p data-main>One.</p><p data-main>The first paragraph of the article says a few
    things about its topic in some plain words.</p><p data-main>See also.</p><ul><li data-main>first item<li data-main>second
    item with more words in it</ul><p data-main><a href=/x>A paragraph that is wholly a link to another page of the site</a></p>
    <div class=ad>Buy this now, it is cheap and it is good and it is here for you today only</div><p data-main>Last words.</p>
    </article><footer>Copyright of the site and all that comes with it, in many words that go on and on</footer></body>""",
    """<body><header><p>The name of the site</p><p>A motto of the site that has quite a few words in it</p></header><main>
    <h2 data-main>Heading</h2><p data-main>Text in the main part, with enough words to be a real paragraph of its page.</p>
    <table><tr><td data-main>cell</td><td data-main>other cell</td></tr></table><blockquote data-main>A quotation</blockquote>
    <aside><p>Aside the text there is a box that has many words, yet it is no part of the article at all</p></aside>
    <p data-main>End</p></main><aside><h3>More</h3><ul><li><a href=1>One story</a><li><a href=2>Two stories and more</a></ul>
    </aside></body>""",
    """<body><div id=menu><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=content><h1 data-main>Title of it</h1>
    <p data-main>Some words here.</p><p data-main>More words that make the paragraph a little longer than the one before it
    was.</p></div><div class=sidebar><p>Words in the sidebar that are many but that belong to no article whatsoever</p>
    <form><label>Your mail</label><button>Send it to us</button></form></div><p>Outside</p><p>Words after the content that
    are as many as those of a paragraph, outside all of it</p></body>""",
    """<body><p><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Sport</a></p><h1 data-main>The title of a page without marks</h1>
    <p data-main>A page of the old kind has no marks of its parts, only paragraphs of text that are long enough to be told
    from the lists of links around them by the number of their words.</p><p data-main>A second paragraph follows, with a
    <a href=4>link</a> in it and many words beside that link, so the share of linked words is small.</p><p data-main>A short
    one between.</p><p data-main>The last paragraph of the text is long again and closes what was said before, as such
    paragraphs do on pages of this kind.</p><p><a href=5>Contact</a> <a href=6>Imprint</a></p><p>Copyright 2001</p></body>""",
    """<body><ul><li><a href=1>Start</a><li><a href=2>Archive of everything</a><li><a href=3>Links</a></ul><div><p data-main>Once
    more a text without marks, in which each of the paragraphs has more than a dozen words in a row and no link.</p>
    <p data-main>It goes on with another paragraph of the same kind, just to have two neighbours that are both long.</p></div>
    <div><a href=7>Read on</a></div><div><a href=8>Another story that has a long title of many words in one link</a></div>
    <div>Login</div><div>Search</div></body>""",
    """<body><article><header><h1 data-main>Title in a header</h1><p>By someone, yesterday at noon, in the section of many
    things</p></header><p data-main>Text.</p><p data-main>A text that is longer and has a sentence or two. Here is the second.</p>
    <section id=comments><h3>Comments</h3><p>I liked this article a lot and would read another one of the same kind</p>
    <article><p>Me too, said a reader</p></article></section></article><div class="cookie notice">We use cookies to make the
    page better for you and for all others, please agree</div></body>""",
    """<body><div>Menu</div><div>Skip</div><p>Posted on Monday</p><h2 data-main>What the page is about</h2><p data-main>Again the
    paragraphs have no marks around them, and what tells them is that they hold words, many of them, in sentences.</p>
    <p data-main>This one is as long as the other, and stands beside it, and it also ends with a full stop in the end.</p>
    <div>Share</div><div>Print</div></body>""",
    """<body><div class=ad>An advert before the text ends as a sentence does.</div><div class=ad>It is here. And here.</div><article>
    <h1 data-main>A title that ends with a stop.</h1><p data-main>Short. Text.</p><p data-main>no stop here</p><p data-main>Then
    comes a paragraph of some length, which is part of the article and ends with a stop as most of them do.</p></article>
    <footer>All that stands down here is the small print of the site, in words as many as a paragraph has them, and it ends with
    a stop.</footer><p>Some more of the small print, which is not part of anything and ends with a stop as well, for good.</p>
    <p>One more sentence of that kind, with its dozen words and more, after the end of all parts.</p></body>""",
    """<body><p>Before the main part there is a sentence that is long enough to be taken for a paragraph of the text.</p><p>There
    may even be two of them, one below the other, and both end with a full stop as sentences do in a text.</p><main><p data-main>
    Main text that is not long.</p><p data-main>And more</p></main><p>After it comes a sentence that thanks all readers of the
    page for their time and their patience.</p><div>And another one that says where to write to, for whoever wants to write.</div>
    <section class="related posts"><p>Related stories are told here in a sentence or two that end with a full stop each.</p>
    </section></body>""",
    """<body><div class="ad banner">An advert on a page without marks may be as long as any of its paragraphs, and end with a stop
    just as they do, so only its name tells it.</div><p data-main>The text itself is the same as on other pages, long enough and
    without links, one sentence after the other, and it has no mark.</p><div class=promo>Here is the next advert of that page,
    which is also rather long and says that all is cheap and all is new and all is yours.</div><p data-main>The text goes on after
    it with a paragraph that has again many words and not a single link, and then it is over.</p><footer>The page ends with the
    usual words on rights and on the year in which they were reserved, all of them, everywhere and for ever.</footer>
    <form>Fill in this form with all you know about yourself and your friends, and send it to us this very day, please.</form>
    <div class=comments><p>A reader has written a long comment, with more than a dozen words in it, and it ends with a stop.</p>
    <p>Another reader has answered that comment with a comment that is nearly as long as the first one was.</p></div></body>""",
    """<body class="single ad-free"><div class="page no-ads"><article class="post category-social tag-search"><h1 data-main>A title
    below names</h1><p data-main>The names of this article have words of other parts in them, yet it is one, as its tag says.</p>
    <p data-main>Short.</p><div class=share>Share this text with all of your friends, today and on any other day of the
    year.</div></article></div><footer>Rights and more, in as many words as a paragraph of the article above has.</footer></body>""",
    """<body><div class=post-content><h1 data-main>A title over parts with long names</h1><p data-main>The text is in a part whose
    name says so, and it has paragraphs of many words each, all of them in plain sentences that end with a stop.</p><div
    class="inline-advert box"><p>An advert between two paragraphs has as many words as they do, and it ends with a stop like them.
    </p></div><p data-main>The second paragraph comes after the advert, and it is just as long as the first one before it was.</p>
    <div class=sponsored-content><p>What somebody has paid for is told here at some length, in a sentence that looks like the text.
    </p></div></div><section class=reader-comments><p>A reader says in many words that the text was good, and that more of that kind
    would be good, too.</p></section><div id=disqus_thread><p>Another reader says the same in other words, of which there are many,
    one after the other.</p></div><div class=cookie-notice-bar><p>This page sets cookies, as all pages do, and it asks you to be
    content with that from now on.</p></div></body>""",
    """<body><form id=aspnetForm><ul><li><a href=1>Home</a><li><a href=2>All the news</a></ul><main><h1 data-main>In a form</h1>
    <p data-main>The whole page is wrapped in a form here, as some servers do it, and its main part is the article.</p>
    <p data-main>End of it</p></main><div class="hidden-print links"><a href=3>One more page of this site</a></div></form></body>""",
]
