"""Pages of layouts that no training page has, as a page maker would write them, with the label of each leaf block."""

import random


def _say(r, low, high):
    w = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
    return " ".join(w).capitalize() + "."


def news(r):
    out, y = ['<body><div id="skip"><a href="#m">' + _say(r, 2, 3) + '</a></div><div class="masthead-wrap"><span>' + _say(r, 1, 3) + "</span></div>"], [False, False]
    out.append('<div class="global-navigation"><ul>' + "".join(f'<li><a href="/{i}">{_say(r, 1, 2)}</a></li>' for i in range(6)) + '</ul></div><div class="cookie-banner"><p>' + _say(r, 8, 20) + "</p><button>" + _say(r, 1, 1) + "</button></div>")
    y += [False] * 8
    out.append('<div class="story-container"><h1>' + _say(r, 4, 9) + '</h1><div class="story-body">')
    y.append(True)
    for _ in range(r.randint(3, 9)):
        out.append(f"<p>{_say(r, 20, 70)}</p>")
        y.append(True)
        if r.random() < 0.2:
            out.append(f'<div class="related-coverage-story"><a href="/r">{_say(r, 4, 10)}</a></div>')
            y.append(False)
    out.append('</div></div><div class="reader-comments"><h3>' + _say(r, 1, 2) + "</h3>" + "".join(f'<div class="comment-body"><p>{_say(r, 5, 30)}</p></div>' for _ in range(3)) + '</div><div class="page-footer"><p>&copy; ' + _say(r, 2, 6) + "</p></div></body>")
    return "".join(out), [*y, False, False, False, False, False]


def blog(r):
    out, y = ['<body><header class="site-header"><a href="/">' + _say(r, 1, 3) + "</a></header><main><article class='hentry'><h1 class='entry-title'>" + _say(r, 3, 8) + "</h1><div class='entry-meta'>" + _say(r, 3, 5) + "</div><div class='entry-content'>"], [False, True, False]
    for _ in range(r.randint(3, 7)):
        kind = r.random()
        out.append(f"<p>{_say(r, 15, 60)}</p>" if kind < 0.7 else f"<h2>{_say(r, 2, 5)}</h2>" if kind < 0.85 else f"<blockquote>{_say(r, 8, 20)}</blockquote>")
        y.append(True)
    out.append("</div></article></main><aside class='widget-area'><section class='widget'><h2>" + _say(r, 1, 2) + "</h2><ul>" + "".join(f"<li><a href='/{i}'>{_say(r, 2, 6)}</a></li>" for i in range(5)) + "</ul></section></aside><form class='subscribe-form'><label>" + _say(r, 2, 6) + "</label><input></form><footer><small>" + _say(r, 3, 9) + "</small></footer></body>")
    return "".join(out), [*y, *[False] * 8]


def plain(r):
    """No class, id or sectioning element at all."""
    out, y = ["<body><table><tr><td>" + "</td><td>".join(f'<a href="/{i}">{_say(r, 1, 2)}</a>' for i in range(5)) + "</td></tr></table><h1>" + _say(r, 2, 7) + "</h1>"], [*[False] * 5, True]
    for _ in range(r.randint(4, 9)):
        out.append(f"<p>{_say(r, 20, 80)}</p>")
        y.append(True)
    return "".join(out) + "<hr><p>&copy; " + _say(r, 2, 5) + "</p></body>", [*y, False]


def manual(r):
    out, y = ['<body><div class="topnav"><a href="/">' + _say(r, 1, 2) + '</a></div><nav class="toc-tree"><ul>' + "".join(f'<li><a href="#{i}">{_say(r, 1, 4)}</a></li>' for i in range(8)) + '</ul></nav><div role="main" class="document"><section id="intro"><h1>' + _say(r, 2, 5) + "</h1>"], [*[False] * 9, True]
    for _ in range(r.randint(4, 8)):
        kind = r.random()
        if kind < 0.5:
            out.append(f"<p>{_say(r, 10, 50)}</p>")
            y.append(True)
        elif kind < 0.7:
            out.append(f"<pre>{_say(r, 3, 12)}</pre>")
            y.append(True)
        else:
            out.append("<ul>" + "".join(f"<li>{_say(r, 3, 12)}</li>" for _ in range(3)) + "</ul>")
            y += [True] * 3
    return "".join(out) + '</section></div><div class="footer-links"><a href="/p">' + _say(r, 1, 3) + "</a></div></body>", [*y, False]


LAYOUTS = {"news": news, "blog": blog, "plain": plain, "manual": manual}


def pages(name, n=60, seed=5):
    r = random.Random(f"{name}/{seed}")
    return [LAYOUTS[name](r) for _ in range(n)]
