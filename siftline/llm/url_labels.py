"""The small labelled table of the URL filter: URLs as the web has them, written by hand, by kind.

Wanted ones are well-known public sites and the usual shapes of blogs, shops, schools and offices;
unwanted ones are invented, since such hosts come and go. None is taken from the tables of tests.
"""

from __future__ import annotations

import random
import zlib

WANTED: dict[str, str] = {
    "reference": """en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Donau fr.wikipedia.org/wiki/Loire es.wikipedia.org/wiki/Cervantes
        www.britannica.com/animal/otter en.wiktionary.org/wiki/threshold www.merriam-webster.com/dictionary/thorough simple.wikipedia.org/wiki/Nation
        plato.stanford.edu/entries/truth www.gutenberg.org/ebooks/1342 archive.org/details/atlas1890 commons.wikimedia.org/wiki/Category:Bridges
        www.openstreetmap.org/relation/62422 www.wikidata.org/wiki/Q42 dictionary.cambridge.org/dictionary/english/nation""",
    "science": """arxiv.org/abs/1706.03762 www.nature.com/articles/s41586-020-2649-2 pubmed.ncbi.nlm.nih.gov/31452104 journals.plos.org/plosone/article
        www.science.org/doi/10.1126/science.1225829 www.nasa.gov/missions/voyager home.cern/science/experiments www.pnas.org/content/117/5 doi.org/10.1038/nature14539
        www.esa.int/Science_Exploration ocw.mit.edu/courses/mathematics www.biorxiv.org/content/2021.03 zenodo.org/record/4421 www.jstor.org/stable/2118559""",
    "code": """github.com/apache/spark/issues/1204 docs.python.org/3/library/heapq.html stackoverflow.com/questions/11227809/why-is-it-faster developer.mozilla.org/en-US/docs/Web/HTML
        pypi.org/project/requests gitlab.com/gitlab-org/gitlab/-/merge_requests/77 www.postgresql.org/docs/current/indexes.html kernel.org/doc/html/latest
        doc.rust-lang.org/book/ch04-01.html spark.apache.org/docs/latest/sql-programming-guide.html news.ycombinator.com/item?id=1 www.ietf.org/rfc/rfc2616.txt
        learn.microsoft.com/en-us/dotnet/standard/threading crates.io/crates/serde en.cppreference.com/w/cpp/container/vector""",
    "news": """www.bbc.co.uk/news/world-europe-56720589 www.theguardian.com/environment/2021/apr/12/rivers www.nytimes.com/2019/06/04/travel/trains.html
        www.lemonde.fr/sciences/article/2020/11/03/volcans.html www.spiegel.de/wissenschaft/natur/a-1242.html elpais.com/cultura/2021-02-18/teatro.html
        www.reuters.com/markets/europe/grain-2022-03-01 apnews.com/article/weather-storms www.npr.org/2020/10/05/920/orchestra m.heise.de/news/1288.html
        www.thelocal.se/20210412/nationwide-rail www.thetimes.co.uk/article/theatre-season www.economist.com/the-americas/2020/01/04
        www.aftonbladet.example/nyheter/12 thenational.scot/news/1911.html blog.thestar.example/2017/05""",
    "public": """www.gov.uk/renew-adult-passport www.loc.gov/collections/maps www.cityofboston.example/permits/trees europa.eu/youth/rights_en www.bundestag.de/parlament/geschichte
        www.who.int/news-room/fact-sheets/detail/malaria www.nhs.uk/conditions/asthma www.census.gov/data/tables.html www.un.org/en/about-us/history
        www.legislation.gov.uk/ukpga/1998/29 www.met.no/en/weather data.worldbank.org/indicator/SP.POP.TOTL www.stadtbibliothek.example/oeffnungszeiten.html
        www.mairie-lyon.example/fr/ecoles/12 ayuntamiento.sevilla.example/es/biblioteca""",
    "places": """www.thornbury-school.example/parents/term-dates library.northfield.example/catalogue/8812 www.hatherleigh-parish.example/minutes/2016.html
        museum.lothian.example/exhibitions/bronze theatre-royal.example/whats-on/hamlet www.whittington-hospital.example/patients www.harrow-weather.example/en/today
        choir.thamesford.example/concerts/14 www.thistledown-farm.example/visit www.strathmore-council.example/roads botanic-garden.example/en/glasshouse
        train-times.example/de/fahrplan/311 www.notion-press.example/en/books/55 mathclub.tuition-centre.example/en/notes/7
        station-road-surgery.example/opening www.herring-museum.example/is/12""",
    "blogs": """blog.woodenboats.example/2014/07/steam-bending cookingwithmarta.example/en/lentil-soup.html www.oldmaps.example/post/199 m.birdwatch.example/en/sightings/2
        thegardenpath.example/2012/roses notesontranslation.example/page/3 kitchen-table-physics.example/en/pendulum.html blog.trailrunner.example/de/alpen/88
        www.thinkingaloud.example/en/essays/31/ anotherthing.example/fr/carnet/5 www.themeandvariation.example/en/bach.html blog.ironandthread.example/es/412
        weather-notes.example/en/99 motherandson-bakery.example/fr/pains www.thirdshelf.example/en/reviews/640 therenthenow.example/de/17
        www.withinreason.example/en/2204 m.northernlines.example/en/21/ thrushes.example/es/45 www.orationes.example/la/3""",
}
UNWANTED: dict[str, str] = {
    "gambling": """luckyspin88.bet/slots/welcome royal-roulette.example/bonus www.jackpotpalace.example/en/play onlinecasino-top10.example/review 777slotsmania.example/free-spins
        pokerstarz-bonus.example/join www.bestbettingodds.example/football sportsbet-livescore.example/odds/today mega-casinowin.example/deposit bet365x-mirror.example/en
        blackjack-vip.example/table/4 crypto-casino.example/wager www.winbigbingo.example/de/spielen freebet-bonuscode.example/claim/22 casinos-sin-deposito.example/es/bono
        betting-tips-vip.example/fr/paris sure-win-bets.example/tips wettbonus.example/de/bet sportingbets24.example/en/live slot-gacor-win.example/daftar""",
    "pharmacy": """best-viagra-deals.ru/order buycialis-online.example/cheap www.cheapmeds-rx.example/pills canadian-pharmacy-discount.example/no-prescription
        dietpills-fast.example/lose-weight cheaptramadol.example/buy/overnight generic-pills-shop.example/levitra www.pillstorm.example/en/sale rx-pills-direct.example/cart
        weightloss-miracle-pills.example/offer steroidshop24.example/anabol cheap-xanax-pills.example/checkout male-enhancement-pill.example/trial
        medikamente-ohne-rezept.example/pillen pastillas-baratas.example/es/comprar""",
    "adult": """hotcamgirls.example/live xxxvideos-tube.example/watch/991 adultfriend-hookup.example/join www.sexchat-now.example/girls nakedcelebs.example/gallery
        adult-dating-x.example/en/profiles freeporntube.example/hd milf-cams.example/room/3 escorts-x.example/city adultx-movies.example/latest xxx-adult-toys.example/shop
        live-sex-adult.example/18 www.x-rated-adult.example/en/5 sexy-singles-tonight.example/signup adult-webcams-xx.example/free hentai-xxx.example/read""",
    "ads": """adserver7.example/click?id=991 ads.trackmetrics.example/pixel.gif tracker-ads.example/imp/22 pop-under-ads.example/serve clicktrack-adnet.example/redirect
        www.adtracking-pro.example/r/18 banner-ads-exchange.example/bid track.affiliate-ads.example/go/551 adclickz.example/out ad-network-tracker.example/en/zone/4
        ads2track.example/beacon adsyndication.example/frame retarget-pixel-track.example/sync push-ads-now.example/subscribe/7 trackads.example/en/conversion/31
        doubleads-track.example/de/klick cookie-track-ads.example/id adtrk.example/cpa/offer""",
    "spam": """buy-backlinks-cheap.example/dofollow seo-linkfarm.example/directory/900 guestpost-spam.example/packages www.articlespinner.example/spun/18 linkfarm-network.example/en/links
        bulk-email-spammer.example/lists spamblast.example/smtp autoblog-farm.example/page/77 content-farm-seo.example/en/keywords link-exchange-farm.example/add
        free-directory-submit.example/seo/links buy-followers-likes.example/instagram comment-spam-bot.example/download www.doorway-pages.example/en/12
        spamfarms.example/feed/3 farm-spam-links.example/fr/liens pbn-links-farm.example/rent spam-mailer-pro.example/de/versand""",
    "fraud": """payday-loans-instant.example/apply fast-cash-loan.example/no-credit double-your-bitcoin.example/invest get-rich-quick.example/system free-iphone-winner.example/claim
        www.prize-winner-claim.example/gift free-giftcards.example/survey cheap-rolex-replica.example/watches replica-handbags-outlet.example/sale secure-paypa1-login.example/verify
        account-suspended-update.example/bank/login appleid-verify-now.example/signin work-from-home-cash.example/earn crypto-giveaway-x2.example/send inheritance-claim.example/contact
        kredit-ohne-schufa-sofort.example/antrag cheap-tickets-free-win.example/en/prize forex-profit-robot.example/signup""",
    "warez": """crackedsoft-keygen.example/photoshop free-serial-keys.example/windows torrentz-movies.example/cam full-crack-download.example/setup.exe warez-nulled.example/themes
        www.codec-update-required.example/install.exe free-vbucks-generator.example/hack malware-dropper.example/payload.bin activator-kms.example/get apk-modded-unlimited.example/coins
        hack-account-tool.example/online watch-movies-free-hd.example/stream""",
}


COINED = 100
SHAPES = 3
_SUB = ("", "www.", "m.", "blog.", "en.")
_TOP = (".com", ".org", ".net", ".de", ".co.uk", ".info", ".fr")
_PATH = ("", "/", "/index.html", "/en/", "/page/3", "/2018/11/", "/de/4711", "/fr/12.html")
_ONSETS = "b br c ch d dr f fl g gr h j k l m n p pl qu r s sh st t th tr v w z".split()
_VOWELS = "a e i o u ai ea io ou".split()
_CODAS = "n r s t l nd nt ng ck sh th m d".split()


def coined(n: int = COINED) -> list[str]:
    """Names that mean nothing, as most hosts' do: they are wanted, so that unknown letters alone count against no URL."""
    r = random.Random(5)
    names = ["".join(r.choice(_ONSETS) + r.choice(_VOWELS) + (r.choice(_CODAS) if r.random() < 0.5 else "") for _ in range(r.randint(2, 4))) for _ in range(n)]
    return [f"{name}.example{r.choice(_PATH)}" for name in names]


def shapes(url: str, n: int = SHAPES) -> list[str]:
    """The URL, and its host's longest label under ``n`` other subdomains, domains and paths, so that those tell nothing of the class."""
    host, _, path = url.partition("/")
    stem, out = max(host.split("."), key=len), [url]
    for i in range(n):
        h = zlib.crc32(f"{i} {url}".encode())
        out.append(_SUB[h % 5] + stem + _TOP[h // 5 % 7] + (_PATH[h // 35 % 8] if i % 2 else f"/{path}"))
    return out


def labelled() -> list[tuple[str, int]]:
    """(URL, 1 for unwanted)."""
    rows = [(u, y) for table, y in ((UNWANTED, 1), (WANTED, 0)) for text in table.values() for u in text.split()]
    return [(f"https://{shape}", y) for u, y in [*rows, *((c, 0) for c in coined())] for shape in shapes(u)]
