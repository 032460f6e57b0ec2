"""URL filter: rules by host and path, then logistic regression on hashed character n-grams.

The model sees n-grams of the host and of the path, hashed into 2 ** BITS weights, and is
trained on a small table of labelled URLs (LABELLED, or one of at most MOST rows that the
caller gives). Where a rule fits, the rule decides: a rule "host/path" fits its host and all
subdomains if the url's path starts with the rule's path; the longest rule wins, and of equal
ones the blocking one.

Host: from after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from
there up to "?", "#" or the end.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and
is judged by the model like any other; repeated rows are judged alike; very long urls are
judged whole; an empty table gives no rows; extra columns are kept, and columns named host,
path, rule, verdict or block_score are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import ship

BITS, GRAMS, MOST = 16, (3, 4, 5), 10_000
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A small labelled table, written for this filter: ordinary pages, and those of betting, advertising, adult content, pills,
#: pirated downloads and fraud. Hosts and paths are those that such pages have, each url once.
_ALLOW = """
en.wikipedia.org/wiki/History_of_glass docs.python.org/3/library/functools.html www.gutenberg.org/ebooks/1342 arxiv.org/abs/1706.03762
www.openstreetmap.org/relation/62422 stackoverflow.com/questions/11227809/sorting-an-array news.harbourherald.net/2021/05/14/council-votes-on-bridge
riverside-library.com/catalogue/new-arrivals blog.kitchengarden.org/2019/03/how-to-plant-leeks www.cityofmillbrook.gov/departments/water
recipes.oakandthyme.net/soups/lentil-soup-with-cumin www.northfield.edu/physics/courses/thermodynamics m.weatherwatch.com/forecast/week
forum.bicyclerepair.net/threads/adjusting-a-rear-derailleur.4521 museumofclocks.com/visit/opening-hours shop.paperlanternbooks.org/product/atlas-of-islands
www.saintmaryhospital.net/patients/appointments maps.trailfinder.com/routes/lake-loop www.parliament.uk/business/bills archive.org/details/oldfarmalmanac
journal.marinebiology.net/volume/12/issue/3 birding.marshlands.com/species/grey-heron choirfestival.org/programme/saturday theatre.oldmill.net/whats-on
railway.timetable.com/stations/central www.geologysociety.net/field-guides/basalt blog.woodturning.com/tools/sharpening-a-gouge
www.astronomyclub.org/observing/moon-phases law.citizensadvice.net/housing/tenancy-agreements learn.algebraforall.com/lessons/quadratic-equations
kids.storycorner.net/tales/the-fox-and-the-crow travel.slowroads.com/portugal/alentejo-by-train zoo-and-gardens.org/animals/red-panda
health.familydoctor.net/conditions/asthma www.farmersmarket.com/stalls/honey music.earlystrings.net/composers/dowland www.townhall.com/minutes/2020/november
photos.mountainclub.org/albums/winter-ascent teachersunion.net/resources/lesson-plans science.plainwords.com/articles/why-the-sky-is-blue
www.bakerydistrict.net/bread/rye-sourdough cinema.smallscreen.com/reviews/the-lighthouse-keeper history.oldharbour.org/maps/1850
www.democratichall.net/debates/transport-policy dev.opencompiler.com/manual/optimisation wiki.homebrewing.net/yeast/lager-strains
volunteerfire.com/about/contact statistics.census.gov/tables/population-by-age www.linguistics.org/grammar/relative-clauses
gardening.allotment.net/seasons/spring www.chesscollege.com/openings/caro-kann press.nationaltheatre.net/releases/2018 engineeringtoday.com/bridges/suspension
poetry.quietpage.org/poems/winter-evening www.icelandictours.net/guides/waterfalls data.oceanbuoys.com/stations/44013 www.furnituremuseum.net/collections/chairs
dictionary.wordroots.com/entry/candle encyclopedia.brightmind.org/topic/photosynthesis schoolorchestra.net/concerts/spring podcast.localvoices.com/episodes/17
de.sprachschule.net/kurse/grammatik fr.cuisinefamiliale.com/recettes/tarte-aux-pommes es.viajesdelsur.org/rutas/pueblos-blancos www.stadtbibliothek.net/oeffnungszeiten
code.tinytools.com/repository/readme support.printworks.net/manuals/paper-jam www.rowingclub.com/results/regatta-2022 blog.mapmakers.org/posts/drawing-contours
antiquebooks.net/catalogue/bindings www.villagehall.com/hire/prices www.treesurvey.net/species/oak lighthousetrust.com/visits
"""
_BLOCK = """
www.luckyspins-casino.com/bonus/free-spins-no-deposit casino-royale-slots.org/signup?aff=7731 jackpot.megawin-casino.net/play/slots bet365bonus.com/free-bets/today
www.best-sports-betting.xyz/odds/tips www.online-poker-cash.com/join/bonus-code win-real-money-slots.org/register wins-every-day.net/lottery/jackpot
www.freebets4u.com/claim-free-bet bingo-winners.club/deposit-bonus adserver.clickmedia.com/click?id=8841 ads.popundernetwork.org/serve/banner
track.affiliate-clicks.net/redirect?offer=552 doubleads.com/adclick/728x90 banners.trafficexchange.info/impression cdn.adsyndicate.com/popunder.js
clicktracker.leadsgen.org/pixel/track www.hotxxxtube.net/videos/porn-4431 www.free-porn-clips.com/xxx/category/milf adultcams-live.com/chat/nude
sexy-dating-tonight.com/hookup/signup xxx.nudegalleries.org/pics/sex www.escorts-in-town.net/girls/book cheap-viagra-pills.com/buy-viagra-online
www.discount-cialis.net/order/no-prescription pharmacy-pills-online.com/cheap/xanax www.buy-tramadol.org/without-prescription slimming-pills.net/buy/lose-weight-fast
keygen-cracks.com/download/photoshop-crack.exe www.warez-full-download.com/serial/keygen.zip free-movie-torrent.com/download/full-hd-free
cracked-apks.org/mod/unlimited-coins www.download-now-free.net/setup.exe?src=pop payday-loans-instant.com/apply/bad-credit quick-cash-loan.net/approved/today
www.make-money-fast.com/work-from-home/secret crypto-doubler.org/invest/double-your-bitcoin bitcoin-profit-now.net/signup/free-bonus www.forex-millionaire.com/earn/money
you-won-a-prize.club/claim/iphone free-gift-cards.com/survey/claim-now www.account-verify-login.org/secure/update-password paypal-security-check.net/login/verify
replica-watches-cheap.com/rolex/sale www.cheap-designer-bags.shop/replica/discount instagram-followers-buy.com/cheap/likes seo-backlinks-cheap.org/buy/links
www.hot-singles-near.net/dating/free-signup cams.adultfriend.com/live/sex-chat miracle-weightloss.info/buy-now/pills spam-bulkmailer.com/buy/email-lists
www.weed-shop-online.org/order/cheap betting-odds-free.net/win/tips slots-of-luck.com/casino/spins www.free-vbucks-generator.net/hack/free lottery-winner.com/claim/prize
porn-hd-free.org/watch/xxx www.sex-videos-free.net/tube/porn ads.cheap-traffic.com/buy/clicks adult-toys-cheap.shop/sale/sex tracking.mailblast.com/open/pixel
"""
LABELLED = [(f"https://{url}", label) for label, urls in ((0, _ALLOW), (1, _BLOCK)) for url in urls.split()]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def places(host: str, path: str) -> list[int]:
    """The weights that a url uses."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in found})


class Rules:
    """Rules by host; the longest that fits a url."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[int, bool, str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((len(rule), verdict == "block", f"/{path}", rule, verdict))

    def fit(self, host: str, path: str) -> tuple[str, str] | None:
        best, part = None, host
        while True:
            for rule in self.by_host.get(part, ()):
                if path.startswith(rule[2]) and (best is None or rule[:2] > best[:2]):
                    best = rule
            _, dot, part = part.partition(".")
            if not dot:
                return best and best[3:]


def train(labelled: list[tuple[str, int]], turns: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, by gradient descent on the logistic loss. A url's n-grams count by one over the root of their number."""
    if len(labelled) > MOST:
        raise ValueError(f"at most {MOST} labelled urls")
    rows = [places(*split_url(u)) for u, _ in labelled]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    gram = np.array([g for r in rows for g in r], dtype=np.int64)
    value = np.repeat([1 / max(1, len(r)) ** 0.5 for r in rows], [len(r) for r in rows])
    y = np.array([k for _, k in labelled], dtype=float)
    weights = np.zeros((1 << BITS) + 1)
    for _ in range(turns if len(rows) else 0):
        z = np.bincount(owner, weights[gram] * value, minlength=len(rows)) + weights[-1]
        off = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(gram, off[owner] * value, minlength=1 << BITS) / len(rows)
        weights[:-1] -= rate * 20 * (slope + ridge / 20 * weights[:-1])
        weights[-1] -= rate * off.mean()
    return weights.astype(np.float32)


def block_score(weights: np.ndarray, host: str, path: str) -> float:
    own = places(host, path)
    z = float(weights[own].sum()) / max(1, len(own)) ** 0.5 + float(weights[-1])
    return float(1 / (1 + np.exp(-z)))


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and block_score (the model's, for every url)."""
    spark = pages.sparkSession
    ship(spark)
    table = LABELLED
    if labelled is not None:
        table = sorted((r["url"], int(r["block"])) for r in labelled.select("url", "block").where("url IS NOT NULL AND block IS NOT NULL").limit(MOST + 1).collect())
    weights = train(table)
    pages = pages.drop("host", "path", "rule", "verdict", "block_score")
    added = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()), ("block_score", T.DoubleType())]
    schema = T.StructType([*pages.schema.fields, *(T.StructField(n, t) for n, t in added)])
    sent = spark.sparkContext.broadcast(weights)

    def run(batches):
        known, model = Rules(rules), sent.value
        for batch in batches:
            rows = []
            for u in batch.column(url):
                host, path = split_url(u.as_py())
                rule, verdict = known.fit(host, path) or (None, None)
                score = block_score(model, host, path)
                rows.append((host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), score))
            new = [pa.array([r[k] for r in rows], pa.float64() if k == 4 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in added)])

    return pages.mapInArrow(run, schema)
