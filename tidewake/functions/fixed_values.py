"""Word lists, lookup tables and constants that results depend on. Stated as they are, in their natural order."""

#: Stop words of the thin-content test.
THIN_STOPWORDS = tuple(
    """
    the a an and or but of to in on at by for with is are was were be been being this that these those it its as from
    into than then so if not no do does has have had will would can could should may might
    """.split()
)

#: Language of a top-level domain.
TLD_LANGUAGE = {
    "de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es",
    "cl": "es", "pe": "es", "it": "it", "ru": "ru", "by": "ru", "cn": "zh", "tw": "zh", "hk": "zh", "jp": "ja",
    "kr": "ko", "br": "pt", "pt": "pt", "nl": "nl", "se": "sv", "no": "no", "fi": "fi", "dk": "da", "pl": "pl",
    "cz": "cs", "sk": "sk", "hu": "hu", "ro": "ro", "tr": "tr", "gr": "el", "il": "he", "sa": "ar", "ae": "ar",
    "eg": "ar", "ir": "fa", "th": "th", "vn": "vi", "id": "id", "in": "en", "uk": "en", "us": "en", "ca": "en",
    "au": "en", "nz": "en", "ie": "en", "za": "en", "ng": "en", "ke": "en", "ph": "en", "com": "unknown",
    "org": "unknown", "net": "unknown", "info": "unknown",
}

#: Signs of UTF-8 read as Latin-1.
MOJIBAKE_MARKERS = (
    "Â", "â€", "Ã©", "Ã¨", "Ã¢", "Ã ", "Ã±", "Ã¶", "Ã¼", "Ã¤", "Ã¡", "Ã­", "Ã³",
)

#: Themes that let a record through the prefilter.
HIGH_SIGNAL_THEMES = tuple(
    """
    INFORMATION_WARFARE DISINFORMATION PROPAGANDA MEDIA_CENSORSHIP CYBER_ATTACK ELECTION PROTEST MILITARY SANCTIONS COUP
    POLITICAL_TURMOIL CONSPIRACY CORRUPTION WEAPONIZED_NARRATIVE INFLUENCE_OPERATION TAX_FNCACT CRISISLEX_T03_DEAD
    """.split()
)

#: One of these makes a post relevant.
SIGNAL_PHRASES = (
    "psyop", "false flag", "info war", "bot network", "astroturf", "influence operation", "media manipulation",
    "whistleblower", "who benefits", "follow the money", "cui bono", "state-sponsored", "troll farm", "sockpuppet",
    "coordinated inauthentic",
)

#: Two of these make a post relevant.
SIGNAL_WORDS = (
    "disinformation", "propaganda", "narrative", "manipulation", "coordinated", "leaked", "exposed", "classified",
    "censorship", "cover up",
)

#: Words that never stand in a label.
LABEL_STOPWORDS = tuple(
    """
    the a an of for they them their is are was were be been to in on at by with from as it its this that these those and
    or but if then also more most less such into than which who whom whose what when where why how there here up down
    out over under again further once e i ii iii iv v
    """.split()
)

#: Characters that keep a token out of a label.
MOJIBAKE_CHARS = tuple(
    """
    â Ã Â ð ¢ ã ä å æ è é ê ë ì í î ï
    """.split()
)

#: Separators before a title's suffix, tried in this order.
TITLE_SEPARATORS = (
    " â ", " — ", " - ",
)

#: Words that never are keywords.
KEYWORD_STOPWORDS = tuple(
    """
    the a an is are was were be been being have has had do does did will would could should may might shall can need
    dare ought used to of in for on with at by from as into through during before after above below between out off over
    under again further then once here there when where why how all both each few more most other some such no nor not
    only own same so than too very just because and but or if while that this it its they them their what which who whom
    these those http https www com org themes via html net del php asp jsp htm news article articles releases release
    index page post posts tag tags category section topic latest view read click link full co uk au ca gov edu io los
    las una por con sur les der die das von und fur des gdelt gkg source record
    """.split()
)

#: Stop words of title similarity.
TITLE_STOPWORDS = tuple(
    """
    a an and are as at be by for from has have he in is it its of on or that the this to was were will with but not they
    their them we our you your i my me she her his him us if so no yes do does did say says said what which who how when
    where why than then into over under after before about against between during without within above below up down out
    off again further all any more most other some such only own same too very can could should would may might must
    just now new one two three four five news today yesterday tomorrow
    """.split()
)

#: Wire services.
WIRE_SERVICES = tuple(
    """
    apnews.com reuters.com afp.com upi.com efe.com dpa.de kyodonews.jp xinhuanet.com bbc.co.uk bbc.com
    """.split()
)

#: Syndication domains.
SYNDICATORS = tuple(
    """
    ap.org reutersmedia.com afpforum.com pressassociation.com pa.media pa.press.net
    """.split()
)

#: Themes of the high-signal-topic test.
MANIPULATION_THEMES = tuple(
    """
    INFORMATION_WARFARE DISINFORMATION PROPAGANDA CONSPIRACY WEAPONIZED_NARRATIVE INFLUENCE_OPERATION MEDIA_CENSORSHIP
    """.split()
)

#: Domains left out of source overlap.
SHARED_WIRE_DOMAINS = tuple(
    """
    reuters.com apnews.com afp.com bbc.co.uk bbc.com theguardian.com nytimes.com wsj.com bloomberg.com
    washingtonpost.com cnn.com aljazeera.com ft.com cnbc.com thehill.com politico.com axios.com
    """.split()
)

#: Function words of the stylometric vector; its first twenty get a frequency each.
FUNCTION_WORDS = tuple(
    """
    the of and to in that it was for on are as with his they at be this have from or one had by but not what all were we
    when your can said there use an each which she do how their if will up other about out many then them these so some
    her would make like him into time has look two more write go see number no way could people my than first water been
    call who oil its now find long down day did get come made may part
    """.split()
)

#: Web words that never stand in a label.
URL_ARTIFACTS = tuple(
    """
    html htm www com org net http https php asp aspx jsp index page article news story post blog the and for from with
    that this del per con les des den der die das und von info site media online digital press noticias journal gazette
    herald tribune times daily weekly topics people organizations tone themes
    """.split()
)

#: Readable names of themes.
THEME_NAMES = {
    "Soc Generalcrime": "Crime", "Soc Pointsofinterest": "Infrastructure",
    "Soc Pointsofinterest Hospital": "Hospitals", "Soc Pointsofinterest Airport": "Airports",
    "Soc Pointsofinterest School": "Schools", "Ungp Forests Rivers Oceans": "Environment",
    "Manmade Disaster Implied": "Industrial Disaster", "Econ Taxation": "Taxation", "Drug Trade": "Drug Trade",
    "Crime Illegal Drugs": "Illegal Drugs", "Information Warfare": "Information Warfare",
    "Media Censorship": "Censorship", "Armed Conflict": "Armed Conflict", "Armedconflict": "Armed Conflict",
    "Political Turmoil": "Political Turmoil", "Cyber Attack": "Cyber Attack", "Affect": "Humanitarian Impact",
    "Leader": "Political Leaders", "Protest": "Protests", "Military": "Military", "Election": "Elections",
    "Corruption": "Corruption", "Sanctions": "Sanctions", "Crisislex T03 Dead": "Casualties", "Medical": "Healthcare",
    "Education": "Education", "Religion": "Religion", "Evacuation": "Evacuations", "Arrest": "Arrests",
    "Security Services": "Security Forces",
}

#: Credibility registry: domain fragment, category, base score; the first fragment found in a domain counts.
REGISTRY = tuple(
    (fragment, category, float(score))
    for fragment, category, score in map(
        str.split,
        """
        apnews wire_service 0.92
        reuters wire_service 0.92
        afp.com wire_service 0.9
        upi.com wire_service 0.85
        efe.com wire_service 0.85
        dpa.de wire_service 0.85
        kyodonews wire_service 0.85
        nytimes major_editorial 0.85
        washingtonpost major_editorial 0.82
        theguardian major_editorial 0.82
        bbc.com major_editorial 0.85
        bbc.co.uk major_editorial 0.85
        economist major_editorial 0.83
        ft.com major_editorial 0.82
        wsj.com major_editorial 0.82
        npr.org major_editorial 0.8
        pbs.org major_editorial 0.8
        latimes major_editorial 0.78
        chicagotribune major_editorial 0.76
        usatoday major_editorial 0.74
        cnn.com major_editorial 0.73
        nbcnews major_editorial 0.73
        cbsnews major_editorial 0.73
        abcnews major_editorial 0.73
        politico major_editorial 0.76
        thehill major_editorial 0.74
        axios.com major_editorial 0.75
        lemonde major_editorial 0.82
        spiegel major_editorial 0.8
        elpais major_editorial 0.78
        corriere major_editorial 0.76
        asahi major_editorial 0.78
        yomiuri major_editorial 0.76
        haaretz major_editorial 0.78
        scmp.com major_editorial 0.74
        aljazeera major_editorial 0.72
        dw.com major_editorial 0.78
        france24 major_editorial 0.76
        thehindu major_editorial 0.74
        timesofindia major_editorial 0.7
        ndtv.com major_editorial 0.7
        abc.net.au major_editorial 0.8
        cbc.ca major_editorial 0.78
        globeandmail major_editorial 0.76
        smh.com.au major_editorial 0.75
        nzherald major_editorial 0.72
        straitstimes major_editorial 0.72
        rt.com state_media 0.35
        sputniknews state_media 0.3
        tass.com state_media 0.4
        xinhua state_media 0.4
        globaltimes state_media 0.35
        chinadaily state_media 0.38
        cgtn.com state_media 0.35
        presstv state_media 0.3
        telesur state_media 0.35
        granma.cu state_media 0.3
        kcna.kp state_media 0.25
        voanews state_media 0.5
        rferl state_media 0.5
        propublica independent_verified 0.85
        bellingcat independent_verified 0.85
        theintercept independent_verified 0.75
        motherjones independent_verified 0.72
        revealnews independent_verified 0.78
        icij.org independent_verified 0.85
        occrp.org independent_verified 0.82
        mediapart independent_verified 0.78
        correctiv independent_verified 0.78
        snopes.com independent_verified 0.8
        politifact independent_verified 0.78
        factcheck.org independent_verified 0.8
        fullfact independent_verified 0.78
        infowars unreliable 0.15
        breitbart unreliable 0.25
        naturalnews unreliable 0.1
        thegatewaypundit unreliable 0.15
        dailywire unreliable 0.3
        oann.com unreliable 0.25
        newsmax unreliable 0.3
        dailykos unreliable 0.35
        occupydemocrats unreliable 0.2
        rawstory unreliable 0.35
        zerohedge unreliable 0.2
        eveningstandard regional_outlet 0.55
        manchestereveningnews regional_outlet 0.55
        liverpoolecho regional_outlet 0.55
        belfasttelegraph regional_outlet 0.55
        walesonline regional_outlet 0.55
        birminghammail regional_outlet 0.55
        chroniclelive regional_outlet 0.55
        yorkshirepost regional_outlet 0.55
        glasgowtimes regional_outlet 0.55
        edinburghnews regional_outlet 0.55
        expressandstar regional_outlet 0.55
        shropshirestar regional_outlet 0.55
        thecourier regional_outlet 0.55
        dorsetecho regional_outlet 0.55
        theargus regional_outlet 0.55
        eadt regional_outlet 0.55
        ipswichstar regional_outlet 0.55
        thenorthernecho regional_outlet 0.55
        sunderlandecho regional_outlet 0.55
        wirralglobe regional_outlet 0.55
        lancashiretelegraph regional_outlet 0.55
        oxfordmail regional_outlet 0.55
        swindonadvertiser regional_outlet 0.55
        worcesternews regional_outlet 0.55
        herefordtimes regional_outlet 0.55
        southwalesargus regional_outlet 0.55
        greenocktelegraph regional_outlet 0.55
        bournemouthecho regional_outlet 0.55
        dailyecho regional_outlet 0.55
        portsmouth.co.uk regional_outlet 0.55
        thestar.co.uk regional_outlet 0.55
        lep.co.uk regional_outlet 0.55
        gazettelive.co.uk regional_outlet 0.55
        yorkpress.co.uk regional_outlet 0.55
        wiltshiretimes regional_outlet 0.55
        countypress regional_outlet 0.55
        bucksfreepress regional_outlet 0.55
        guardian-series regional_outlet 0.55
        newsandstar regional_outlet 0.55
        cumbriacrack regional_outlet 0.55
        cambridge-news regional_outlet 0.55
        norfolkeveningnews regional_outlet 0.55
        norwichgazette regional_outlet 0.55
        kentonline regional_outlet 0.55
        kentlive regional_outlet 0.55
        essexlive regional_outlet 0.55
        surreycomet regional_outlet 0.55
        getwestlondon regional_outlet 0.55
        mylondon regional_outlet 0.55
        bristolpost regional_outlet 0.55
        gloucestershirelive regional_outlet 0.55
        somersetlive regional_outlet 0.55
        devonlive regional_outlet 0.55
        cornwalllive regional_outlet 0.55
        plymouthherald regional_outlet 0.55
        nottinghampost regional_outlet 0.55
        leicestermercury regional_outlet 0.55
        derbytelegraph regional_outlet 0.55
        staffslive regional_outlet 0.55
        stokesentinel regional_outlet 0.55
        coventrytelegraph regional_outlet 0.55
        bedfordshirelive regional_outlet 0.55
        hulldailymail regional_outlet 0.55
        pennlive.com regional_outlet 0.55
        nj.com regional_outlet 0.55
        mlive.com regional_outlet 0.55
        silive.com regional_outlet 0.55
        masslive.com regional_outlet 0.55
        lehighvalleylive.com regional_outlet 0.55
        al.com regional_outlet 0.55
        cleveland.com regional_outlet 0.55
        oregonlive.com regional_outlet 0.55
        syracuse.com regional_outlet 0.55
        """.strip().splitlines(),
    )
)

#: Entities too generic to show that posts share a story.
GENERIC_ENTITIES = (
    "european union", "united states", "european commission", "government", "apple", "samsung", "google", "amazon",
    "microsoft", "facebook", "meta", "president", "minister", "prime minister", "mayor", "governor", "senator",
    "spokesperson", "official", "police", "court", "parliament", "congress", "reuters", "associated press", "bbc", "cnn",
    "white house", "kremlin", "china", "russia", "india", "japan", "france", "germany", "ukraine", "united nations", "nato",
    "world bank", "imf", "world health organization",
)

#: ISO codes of language names.
LANGUAGE_CODES = {
    "English": "en", "Spanish": "es", "French": "fr", "German": "de", "Chinese": "zh", "Russian": "ru", "Arabic": "ar",
    "Hindi": "hi", "Portuguese": "pt", "Japanese": "ja", "Korean": "ko", "Turkish": "tr",
}

#: Keywords left out of theme affinity.
AFFINITY_NOISE = tuple("news html net del www com org article releases index source gdelt gkg".split())

#: Titles that aren't news.
NOISE_TITLE = (
    r"[0-9]+\s+(Science|Best|Worst|Things|Ways|Reasons|Tips|Secrets|Facts|Photos|Pictures|Signs|Jobs)"
    r"|(Obituari|Police\s+Report|Sports\s+Roundup|News\s+Quiz|Weekly\s+Roundup|Briefly|Classified)"
    r"|(Top\s+[0-9]+|Top\s+Ten|[0-9]+\s+Things|Quiz:)"
)

#: Taxonomy codes that never stand in a label.
TAXONOMY_CODE = r"^(wb|ungp|crisislex|fncact|epu|armedconflict|govt)[a-z_0-9]*$|^(tax|eth|env|econ|edu|natural)(_[a-z_0-9]+)?$"

#: Sources that are feeds of batches.
FEEDS = ("gdelt_gkg", "gdelt_doc")

#: Verdict of the first rule that fired.
RULE_VERDICTS = {
    "gdelt_batch_artifact": "GDELT_BATCH_ARTIFACT", "insufficient_evidence": "INSUFFICIENT_EVIDENCE", "single_source_cluster": "SINGLE_SOURCE_CLUSTER",
    "wire_service": "WIRE_SERVICE_SYNDICATION", "dna_match": "NO_DNA_MATCH_FOUND", "ensemble_uncertainty": "ENSEMBLE_UNCERTAIN",
    "entity_concentration": "TOPIC_CLUSTER", "narrative_coherence": "INCOHERENT_NARRATIVE", "organic_viral_spread": "ORGANIC_VIRAL_SPREAD",
    "normal_news_cycle": "NORMAL_NEWS_CYCLE", "confidence_threshold": "LOW_CONFIDENCE",
}
