"""Default dictionaries and constants. All are defaults of parameters; an application passes its own."""

# Endings that the Korean word stem is freed of, and words that are left out, by language.
PARTICLES = (
    "으로부터 까지 에서부터 이라는 라는 에서 으로 까지 부터 에게 한테 에는 에도 이나 라도 이며 하며 되어 됐다 했다 한다 됨 임 은 는 이 가 을 를 의 와 과 도 만 로 에 고 서 다 며"
).split()
STOP_KO = "있다 없다 되다 됐다 한다 했다 이다 아니다 통해 위해 대해 대한 관련 이후 당시 통한 밝혔다 전했다 나타났다 것으로 것이다 것을 것은 것이 라고 이라고 하는 되는 있는 없는".split()
STOP_KO_MORE = "에서 만에 따르면 에는 에도 까지 부터 에게 라며 이에 때문".split()
STOP_EN = (
    "the and of in on at for with from to by as is was were be been being this that these those it its his her their our your my he she they we you who whom which what when where "
    "while since into onto out off up down over under across per via amid among between during after before than such very so no not but or if then also more most much many some any "
    "all each other another both few new first second third one two three said says according announced reported included including have has had will would can could should may might did does do "
    "an a are about officially recently previously currently"
).split()
STOP_EN_MORE = (
    "through without within against toward towards upon until once every same own only just still even yet here there how why because around again later early last next them him "
    "itself himself herself themselves due along behind beyond despite although though whether either neither nor however therefore thus already till various several"
).split()
STOP_LATIN = (
    "el la los las de del en un una que por para con su sus es se lo al y o como más le les des et une dans sur avec pour au aux du est ce qui ne pas plus son sa ses "
    "os as um uma do da dos das no na nos nas é não com mais ao são foi ser também pelo pela "
    "yang dan di ke dari untuk pada dengan ini itu juga akan telah adalah oleh sebagai tidak ada tersebut sekali boleh benar sudah saat hingga karena tentang seperti bahwa agar namun atau tetapi jika "
    "kami kita mereka dia ia anda saya lebih bisa harus và của là có cho trong được này với các những một đã để từ không khi tại về người rất cũng trên nhiều sẽ bị "
    "ve bir bu için ile olarak gibi daha çok ise ya ama ang ng mga ay at si ni kay ito"
).split()
STOP_JA = "する いる ある こと もの ため よう これ それ あれ この その なる できる という いう さん たち ない くる いく みる しまう くれる もらう ところ とき ほう".split()
STOP_ZH = (
    "的 了 在 是 和 与 也 都 就 而 及 或 对 但 而且 因为 所以 一个 这个 那个 为 被 着 地 得 很 又 并 以 之 其 此 有 我 你 他 她 它 们 这 那 个 上 下 中 不 人 会 可以 "
    "到 从 把 将 于 所 等 但是 还 还是 已 已经 没有 什么 怎么 如何 于是 因此"
).split()
STOP_RU = "и в не на что с по для как это к из за от но а же то его её их он она они мы вы я у о об до при бы ли так все этот эта эти также или уже ни этом том после когда этой".split()

# Words that raise the score of an item, by kind of evidence, and the weights of the score.
BONUS = {
    "loyalty": "기부 돌파 매진 출범 창단 결성 총공 역사 지속 확장 1위 최초 신기록 밀리언셀러 팬클럽 팬카페 결속 충성 세대".split(),
    "spillover": "경제효과 매출 관광 지자체 앰버서더 모델 브랜드 팝업 협업 관중 방문 상권 지역 홍보대사 수익 투어 콘서트 소비".split(),
}
SCORE_TENTHS = {"item": 10, "number": 5, "word": 3}
UNITS = "만 억 조 % 명 장 위 회 건 주 배 년".split()

# Markets and the words that name them; kinds of organisations and theirs.
MARKETS = {
    "일본": ["일본", "도쿄", "오사카", "재팬", "japan", "tokyo", "osaka"],
    "중화권": ["중국", "대만", "홍콩", "상하이", "베이징", "china", "taiwan", "hong kong", "beijing", "shanghai"],
    "미국_북미": ["미국", "뉴욕", "북미", "america", "usa", "new york", "los angeles", "billboard", "grammy"],
    "유럽": ["유럽", "런던", "파리", "europe", "london", "paris"],
    "동남아": ["동남아", "태국", "베트남", "필리핀", "인도네시아", "싱가포르", "말레이시아", "southeast asia", "thailand", "vietnam", "philippines", "indonesia", "singapore", "malaysia"],
    "글로벌": ["글로벌", "전세계", "월드투어", "해외", "global", "worldwide", "world tour"],
}
ORGANISATIONS = {
    "방송사": ["KBS", "MBC", "SBS", "JTBC", "Mnet", "엠넷"],
    "음원차트_국내": ["멜론", "지니", "벅스", "플로", "가온"],
    "해외차트_시상식": ["빌보드", "Billboard", "오리콘", "Oricon", "AMA", "그래미", "Grammy", "골든디스크"],
    "글로벌플랫폼": ["유튜브", "YouTube", "스포티파이", "Spotify", "넷플릭스", "Netflix", "위버스", "Weverse", "틱톡", "TikTok", "인스타그램", "Instagram"],
    "대형공연장": ["올림픽공원", "올림픽홀", "KSPO", "고척돔", "잠실체육관", "아레나", "코첼라", "Coachella"],
    "매체_어워드": ["포브스", "Forbes", "보그", "Vogue", "엘르", "Elle", "서울가요대상"],
}
# Weights of the parts of the coverage index, and their denominators.
COVERAGE_WEIGHTS = {"language": 0.30, "market": 0.25, "source": 0.20, "time": 0.15, "entity": 0.10}
YEARS = (2015, 2026)

# Hosts by kind and language of source.
HOSTS = {
    "community": ["reddit.com", "x.com", "twitter.com", "facebook.com", "instagram.com", "threads.com"],
    "wiki": ["en.wikipedia.org", "ko.wikipedia.org", "namu.wiki", "wikipedia.org"],
    "ja": ["ygex.jp", "barks.jp", "natalie.mu", "oricon.co.jp", "nikkansports.com", "hochi.news", "sponichi.co.jp", "asahi.com", "yomiuri.co.jp", "mainichi.jp", "nikkei.com", "daily.co.jp"],
    "zh": ["sina.com.cn", "weibo.com", "163.com", "people.com.cn", "xinhuanet.com", "qq.com", "ifeng.com", "douban.com", "baidu.com", "zhihu.com"],
    "es": ["elpais.com", "marca.com", "abc.es", "elmundo.es", "clarin.com", "infobae.com", "univision.com", "telemundo.com"],
    "fr": ["lemonde.fr", "lefigaro.fr", "liberation.fr", "francetvinfo.fr", "leparisien.fr"],
    "en": [
        "en.wikipedia.org", "billboard.com", "forbes.com", "hollywoodreporter.com", "soompi.com", "allkpop.com", "complex.com", "nextshark.com", "gizmodo.com", "malaymail.com",
        "news24online.com", "nme.com", "gulfnews.com", "variety.com", "koreaherald.com", "koreatimes.co.kr", "pressreader.com", "vietnam.vn", "thejakartapost.com", "koreatimes.com",
    ],
}
EN_SOCIAL = ["reddit.com", "x.com", "twitter.com"]
# Endings of hosts and their languages, in order of precedence.
TLDS = [
    (".co.kr", "ko"), (".or.kr", "ko"), (".go.kr", "ko"), (".kr", "ko"), (".co.jp", "ja"), (".jp", "ja"), (".com.cn", "zh"), (".cn", "zh"), (".hk", "zh"), (".tw", "zh"), (".mg", "zh"),
    (".com.vn", "vi"), (".vn", "vi"), (".com.mx", "es"), (".mx", "es"), (".ar", "es"), (".pe", "es"), (".es", "es"), (".cl", "es"), (".co", "es"), (".co.th", "th"), (".th", "th"),
    (".ru", "ru"), (".fr", "fr"), (".id", "id"), (".com.ph", "tl"), (".ph", "tl"), (".com.br", "pt"), (".br", "pt"), (".pt", "pt"), (".com.tr", "tr"), (".tr", "tr"),
    (".ae", "ar"), (".sa", "ar"), (".eg", "ar"), (".qa", "ar"), (".kw", "ar"), (".ma", "ar"),
]
LANGS = ["ko", "en", "ja", "zh", "es", "fr", "th", "id", "vi", "ru", "tl", "pt", "tr", "ar"]
SECOND_LEVEL = "co com net org ne or ac go gov edu mil web info biz tv".split()

# Regions and the words that name them, in order.
REGIONS = {
    "서울": ["서울"], "부산": ["부산"], "대구": ["대구"], "인천": ["인천"], "광주": ["광주"], "대전": ["대전"], "울산": ["울산"], "세종": ["세종시", "세종특별자치시"],
    "경기": ["경기도", "수원", "성남", "부천", "안산", "화성", "의정부", "남양주"], "강원": ["강원", "춘천", "강릉", "원주", "속초"], "충북": ["충북", "청주"],
    "충남": ["충남", "천안", "아산", "보령"], "전북": ["전북", "전주"], "전남": ["전남", "목포", "순천", "진도", "전라남도"],
    "경북": ["경북", "포항", "경주", "김천", "구미", "울릉"], "경남": ["경남", "창원", "진주", "김해", "거제", "남해"], "제주": ["제주"],
}
# Label buckets of topics with the words that choose them, in order of precedence, and the one for none.
LABELS = [
    ("결속형", "공식 팬클럽 팬덤 팬카페 팬들 커뮤니티 기부 fanclub fandom fans community donated donation charity volunteer relief".split()),
    ("소비력형", "기록 앨범 판매 판매량 발매 음반 누적 세웠 album albums sales sold copies units million ep selling".split()),
    ("현장경제형", "콘서트 공연 티켓 매진 단독 투어 전석 관객 동원 concert concerts tour tickets sold-out soldout venue shows world".split()),
    ("브랜드형", "브랜드 모델 광고 앰버서더 발탁 글로벌 brand ambassador endorsement campaign model global".split()),
    ("차트형", "1위 차트 빌보드 기록 올랐 오르 연속 최초 chart charts billboard number consecutive record records".split()),
    ("미디어형", "무대 방송 출연 조회수 음악방송 공개 stage broadcast views performance released".split()),
    ("성과형", "수상 시상식 대상 흥행 매출 실적 최우수 공로상 베스트 award awards winner won ceremony choice grammy".split()),
]
NO_LABEL = "기타형"
# Names of the unordered pairs of pathways.
PERSONAS = {
    "F1|F2": "핵심소비형", "F1|F3": "집단동원형", "F1|F4": "브랜드동반형", "F1|F5": "글로벌결속형", "F2|F3": "원정소비형",
    "F2|F4": "소비상업형", "F2|F5": "글로벌소비형", "F3|F4": "현장상업형", "F3|F5": "글로벌투어형", "F4|F5": "산업확장형",
}
