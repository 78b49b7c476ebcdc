"""The small labelled table that the page classifier is trained on.

Lines of site furniture by kind, and lines of articles, in five languages. The
training pages are put together from them: a seeded draw of blocks in the order
in which pages have them, so that neighbours are labelled too.
"""

from __future__ import annotations

import random

# Words that stand in menus.
SECTIONS = {
    "en": "Home|News|Guides|Projects|Support|Pricing|Calendar|Products|Contact|Field notes|Downloads|Library|About|Blog|Shop|Archive",
    "zh": "首页|新闻动态|指南|项目|技术支持|资费|日历|产品中心|联系我们|现场笔记|下载|资料库|关于我们|博客|商城|归档",
    "de": "Startseite|Aktuelles|Anleitungen|Projekte|Hilfe|Preise|Kalender|Produkte|Kontakt|Feldnotizen|Downloads|Bibliothek|Über uns|Blog|Archiv",
    "fr": "Accueil|Actualités|Guides|Projets|Assistance|Tarifs|Calendrier|Agenda|Produits|Contact|Carnets|Téléchargements|Bibliothèque|À propos|Blog",
    "pt": "Início|Notícias|Guias|Projetos|Suporte|Preços|Calendário|Agenda|Produtos|Contacto|Cadernos|Transferências|Biblioteca|Sobre nós|Blog",
}
# Words that stand in footers.
LEGAL = {
    "en": "Privacy|Accessibility|Imprint|Sitemap|Terms of use|Cookie settings|Contact|Legal notice",
    "zh": "隐私政策|无障碍|版权声明|网站地图|使用条款|Cookie 设置|联系我们|法律声明",
    "de": "Datenschutz|Barrierefreiheit|Impressum|Sitemap|Nutzungsbedingungen|Cookie-Einstellungen|Kontakt",
    "fr": "Confidentialité|Accessibilité|Mentions légales|Plan du site|Conditions|Gestion des cookies|Contact",
    "pt": "Privacidade|Acessibilidade|Aviso legal|Mapa do site|Termos|Definições de cookies|Contacto",
}
# Short furniture lines by kind.
SHORT = {
    "top": {
        "en": "Menu|Skip to content|Jump to main content|Toggle navigation|Navigation|Open menu",
        "zh": "菜单|跳到正文|导航切换|打开菜单|导航",
        "de": "Menü|Menü öffnen|Zum Inhalt springen|Navigation umschalten|Navigation",
        "fr": "Menu|Aller au contenu|Ouvrir le menu|Navigation|Basculer la navigation",
        "pt": "Menu|Abrir menu|Ir para o conteúdo|Saltar para o conteúdo|Navegação|Alternar navegação",
    },
    "tools": {
        "en": "Sign in|My account|Log in / Register|Basket (0)|Search this site…|Search…|Register",
        "zh": "登录|我的账户|登录 / 注册|购物车（0）|站内搜索|请输入关键词|搜索…|注册",
        "de": "Anmelden|Mein Konto|Anmelden / Registrieren|Warenkorb (0)|Suche…|Website durchsuchen…",
        "fr": "Connexion|Mon compte|Se connecter / S'inscrire|Panier (0)|Rechercher…|Recherche sur le site…",
        "pt": "Entrar|Minha conta|Entrar / Registar|Cesto (0)|Carrinho (0)|Pesquisar…|Pesquisar neste site…",
    },
    "buttons": {
        "en": "Accept all|Manage preferences|Settings|Only necessary|Got it|Reject",
        "zh": "全部接受|管理偏好|设置|仅必要项|知道了|拒绝",
        "de": "Alle akzeptieren|Einstellungen verwalten|Einstellungen|Nur notwendige|Verstanden|Ablehnen",
        "fr": "Tout accepter|Gérer les préférences|Gérer mes choix|Paramètres|Nécessaires uniquement|Seulement l'essentiel|J'ai compris|Refuser",
        "pt": "Aceitar tudo|Gerir preferências|Definições|Só os necessários|Apenas necessários|Entendi|Recusar",
    },
    "ad": {
        "en": "Advertisement|Promoted|Sponsored content|Sponsored|Ad",
        "zh": "广告|推广|赞助内容",
        "de": "Werbung|Anzeige|Gesponserte Inhalte|Gesponsert",
        "fr": "Publicité|Contenu sponsorisé|Sponsorisé|Annonce",
        "pt": "Publicidade|Conteúdo patrocinado|Patrocinado|Anúncio",
    },
    "share": {
        "en": "Share|Share this page|Print|Copy link|Send by e-mail",
        "zh": "分享到|分享本页|打印本页|复制链接|邮件发送",
        "de": "Teilen|Seite teilen|Seite drucken|Link kopieren|Per E-Mail senden",
        "fr": "Partager|Partager cette page|Imprimer|Copier le lien|Envoyer par e-mail",
        "pt": "Partilhar|Partilhar esta página|Imprimir|Copiar ligação|Enviar por e-mail",
    },
    "related": {
        "en": "Most read|Related articles|Recent posts|You may also like|More from this section",
        "zh": "阅读排行|相关文章|最新发布|猜你喜欢|本栏目更多",
        "de": "Meistgelesen|Ähnliche Artikel|Neueste Beiträge|Das könnte Sie auch interessieren|Mehr aus dieser Rubrik",
        "fr": "Les plus lus|Articles liés|Derniers billets|Vous aimerez aussi|Dans la même rubrique",
        "pt": "Mais lidos|Artigos relacionados|Últimas publicações|Veja também|Mais desta secção",
    },
    "end": {
        "en": "Back to top|↑ Top|All rights reserved.|Reproduction only with permission.|Powered by NoteQuarry|Theme: Plain Slate|Hosted on a small green server",
        "zh": "返回顶部|↑ 顶部|版权所有，未经许可不得转载。|转载请注明出处。|由 NoteQuarry 驱动|主题：素石|技术支持：砚台工坊",
        "de": "Nach oben|↑ Seitenanfang|Alle Rechte vorbehalten.|Nachdruck nur mit Erlaubnis.|Erstellt mit NoteQuarry|Design: Schlichter Schiefer",
        "fr": "Haut de page|↑ Haut|Tous droits réservés.|Reproduction interdite sans accord.|Propulsé par NoteQuarry|Thème : Ardoise",
        "pt": "Voltar ao topo|↑ Topo|Todos os direitos reservados.|Reprodução só com autorização.|Feito com NoteQuarry|Tema: Ardósia",
    },
    "news": {
        "en": "Subscribe to our newsletter and get one mail per month|Never miss an update – leave your e-mail address|Join 5210 readers and get the weekly digest",
        "zh": "订阅我们的邮件，每月一封|留下邮箱，不错过更新|已有5672位读者订阅每周摘要",
        "de": "Newsletter abonnieren – eine Mail pro Monat|Schon 4410 Leser erhalten unsere Wochenschau|E-Mail-Adresse hinterlassen und nichts verpassen",
        "fr": "Abonnez-vous à la lettre mensuelle|Déjà 3513 lecteurs reçoivent notre résumé|Laissez votre adresse et ne manquez rien",
        "pt": "Assine o boletim mensal|Já são 2210 leitores do nosso resumo|Deixe o seu e-mail e não perca nada",
    },
    "consent": {
        "en": "This website stores small files on your device. Read our cookie policy for details.|We use cookies to keep this site running and to count visits.|Your privacy matters to us: choose which cookies we may set.|By continuing to browse you agree to the use of cookies.|Our pages set small identifiers to keep your session alive; you can change this at any time.|Some partners store tracking data to remember your choice (see privacy page).|This site rely on local storage for visitor statistics unless you object.|Our pages use cookies to pick fitting banners.",
        "zh": "本网站会在您的设备上保存少量数据，详见隐私说明。|本站使用 Cookie 以保证正常运行并统计访问量。|我们重视您的隐私，请选择允许的 Cookie 类型。|继续浏览即表示您同意使用 Cookie。|我们的页面使用本地存储以维持登录状态，您可随时更改。|部分合作方写入标识符用于访问统计（见隐私页）。|本站记录浏览数据以记住您的选择，如不同意请关闭。|我们的页面使用 Cookie用于推送合适内容。",
        "de": "Wir verwenden Cookies, um diese Seite zu betreiben und Besuche zu zählen.|Ihre Privatsphäre ist uns wichtig: Wählen Sie, welche Cookies erlaubt sind.|Mit der weiteren Nutzung stimmen Sie Cookies zu.|Diese Website speichert kleine Dateien auf Ihrem Gerät. Details in der Cookie-Richtlinie.",
        "fr": "Nous utilisons des cookies pour faire fonctionner ce site et compter les visites.|Votre vie privée compte : choisissez les cookies autorisés.|En poursuivant, vous acceptez les cookies.|Ce site enregistre de petits fichiers sur votre appareil. Voir la politique de cookies.",
        "pt": "Usamos cookies para manter este site e contar visitas.|A sua privacidade é importante: escolha os cookies permitidos.|Ao continuar, aceita o uso de cookies.|Este site guarda pequenos ficheiros no seu dispositivo. Veja a política de cookies.",
    },
}
# Beginnings of lines with a list or a link behind them.
TAGS = {"en": "Categories|Tags|Popular topics", "zh": "分类|标签|热门话题", "de": "Kategorien|Schlagwörter|Beliebte Themen", "fr": "Catégories|Étiquettes|Thèmes populaires", "pt": "Categorias|Etiquetas|Temas populares"}
READ = {"en": "Read also", "zh": "延伸阅读", "de": "Lesen Sie auch", "fr": "À lire aussi", "pt": "Leia também"}
# What names of sites end in.
SITE_WORDS = "Archive|Notebook|Works|Journal|资料站|笔记|工坊|知识库|Magazine|Portal"

#: Article lines of each language: title, heading, sentences, list items, terms.
ARTICLE = {
    "en": {
        "title": "Notes on the {t} at Harwex Quay|Report KD-4431 – Tormir Yard|How the crew should seal the {t}|Don’t move the {t} yet: Solel Store",
        "head": "Scope|Readings|Repair record|Contract terms|Alarms|Open points|Site layout|Stock and delivery|Sampling|Purpose",
        "text": "On 2021-03-04 the crew read the {t} twice and noted 41.2 mm near the gate.|The contract for 88 units of {t} was signed in May, with 4 % kept back until acceptance.|Nobody remembers who moved the {t}; the control room only has the entry FG-2210.|The cookie on the test bench expires after 90 minutes, so the desk moved the {t} by hand.|To print the papers of the {t}, search the menu under “Downloads” and accept the value of 12.5 in “Settings”.|Compare sheet 14.|Still open.",
        "terms": "valve|sample rack|loading ramp|storage tank|lining ring|crack gauge",
        "sources": "Sources|References",
    },
    "zh": {
        "title": "溪砚水库{t}监测记录|报告KD-4431：岚泽车站|关于更换{t}的说明（霞川仓库）|2021年6月9日槐沅车站交接单",
        "head": "适用范围|读数记录|维修记录|合同条款|报警处理|遗留问题|场地布置|库存与到货|采样要求|观测目的",
        "text": "2021年3月4日，测量班组两次读取{t}，记录为41.2毫米，编号FG-2210。|88套{t}的采购合同于5月签订，预留4%待值班工程师确认。|没有人记得是谁移动了{t}，合同专员只登记为AP36/874。|测试台写入的 Cookie 在90分钟后失效，因此调度室手动移动了{t}。|分享码KL-77可打印{t}的单据，请在“下载”中搜索，并在“设置”后接受12.5这一数值。|参见第14条。|尚未关闭。",
        "terms": "泄压阀|样本架|装卸坡道|储液罐|衬砌环|裂缝计",
        "sources": "参考资料|资料来源",
    },
    "de": {
        "title": "Überblick {t}, Harwex Kai|Bericht KD-4431 – Tormir Werk|Maßnahmen nach Frost, Solel Lager|Übergabe 04.03.2021 – Nortor Becken",
        "head": "Geltungsbereich|Messwerte|Reparaturen|Vertrag|Alarme|Offene Punkte|Lageplan|Bestand und Lieferung|Probenahme|Zweck",
        "text": "Am 04.03.2021 las die Gruppe den Wert von {t} zweimal ab und notierte 41,2 mm am Tor.|Der Vertrag über 88 Stück {t} wurde im Mai unterzeichnet, mit 4 % Einbehalt bis zur Abnahme.|Niemand weiß, wer {t} bewegt hat; die Leitwarte kennt nur den Eintrag FG-2210.|Das Cookie am Prüfstand läuft nach 90 Minuten ab, deshalb hat die Gruppe {t} von Hand bewegt.|Vergleiche Blatt 14.|Noch offen.",
        "terms": "Ventil|Probenständer|Laderampe|Speicherbecken|Dehnfuge|Rissmesser",
        "sources": "Quellen|Literatur",
    },
    "fr": {
        "title": "Relevé {t} à quai Harwex|Réunion du 04/03/2021 — relais Tormir|Compte rendu après une panne, atelier Solel|Dépôt Nortor : procédure d'entretien MR-3510",
        "head": "Objet|Relevés|Réparations|Contrat|Alarmes|Points ouverts|Périmètre|Stock et livraison|Prélèvement|Grand froid",
        "text": "Le 04/03/2021, l'équipe a relevé deux fois {t} et noté 41,2 mm près de la porte.|Le marché de 88 unités de {t} a été signé en mai, avec 4 % retenus jusqu'à réception.|Personne ne sait qui a déplacé {t} ; la salle de contrôle n'a que l'entrée FG-2210.|Le cookie du banc d'essai expire après 90 minutes, d'où le déplacement de {t} à la main.|Comparer feuille 14.|Encore ouvert.",
        "terms": "soupape|râtelier|rampe de chargement|réservoir|anneau|fissuromètre",
        "sources": "Références|Sources",
    },
    "pt": {
        "title": "Relatório de {t} em cais Harwex|Reunião de 04/03/2021 — estação Tormir|Ações após geada, galpão Solel|Bacia Nortor: instruções de manutenção ZA-8027",
        "head": "Objetivo|Leituras|Reparos|Contrato|Alarmes|Pontos em aberto|Âmbito|Estoque e entrega|Coleta|Tempo frio",
        "text": "Em 04/03/2021, a equipe leu duas vezes {t} e anotou 41,2 mm perto da porta.|O contrato de 88 unidades de {t} foi assinado em maio, com 4 % de retenção.|Ninguém sabe quem moveu {t}; a sala de controle só tem a entrada FG-2210.|O cookie da bancada expira após 90 minutos, por isso a equipe moveu {t} à mão.|Comparar folha 14.|Ainda em aberto.",
        "terms": "válvula|suporte de amostras|rampa de carga|tanque|anel|medidor de fissuras",
        "sources": "Referências|Fontes",
    },
}


def words(table: dict[str, str], lang: str) -> list[str]:
    return table[lang].split("|")


def furniture_phrases() -> dict[str, set[str]]:
    """All furniture phrases by kind, over all languages."""
    out = {kind: {p for lang in langs for p in words(langs, lang)} for kind, langs in SHORT.items()}
    out["section"] = {p for lang in SECTIONS for p in words(SECTIONS, lang)}
    out["legal"] = {p for lang in LEGAL for p in words(LEGAL, lang)}
    out["tags"] = {p for lang in TAGS for p in words(TAGS, lang)}
    out["read"] = {p for lang in READ for p in words(READ, lang)}
    return out


def training_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as lines with their label: 1 furniture, 0 article; blank lines part its blocks."""
    site_lang, lang = rng.choice(sorted(ARTICLE)), rng.choice(sorted(ARTICLE))
    if rng.random() < 0.75:
        lang = site_lang
    art = ARTICLE[lang]
    pick = lambda s: rng.choice(s.split("|"))
    site = ("".join(rng.choice(["Tor", "Har", "Sol", "Kes"]) + rng.choice(["mir", "el", "wex"])) + " " + rng.choice(SITE_WORDS.split("|")[:4])) if site_lang != "zh" or rng.random() < 0.2 else rng.choice("溪岚霞槐") + rng.choice("砚泽川禾") + rng.choice(SITE_WORDS.split("|")[4:8])
    term = lambda: pick(art["terms"])

    def title() -> str:
        """A title; some have words that furniture has as well."""
        own = pick(art["title"]).replace("{t}", term())
        if rng.random() < 0.5:
            return own
        other = rng.choice(words(SHORT[rng.choice(["tools", "share", "news", "end", "related"])], lang))
        some = rng.choice(other.split()).lower() if lang != "zh" else other[:2]
        return f"{own}{'' if lang == 'zh' else ' '}{some}"

    def sentence() -> str:
        """An article's sentence; many use words that furniture has as well, in a longer sentence."""
        plain = lambda: pick(art["text"]).replace("{t}", term())
        if rng.random() > 0.4:
            return plain()
        own = rng.choice(words(SHORT[rng.choice(["consent", "news", "end", "share"])], lang))
        if lang == "zh":
            at = rng.randrange(max(1, len(own) - 4))
            return plain()[:-1] + "，" + own[at : at + rng.randint(2, 8)].strip("。") + "，" + plain()
        some = own.split()
        return plain()[:-1] + ", " + " ".join(rng.choices(some, k=rng.randint(2, 8))).lower().strip(".") + ", " + plain()

    short = lambda kind: rng.choice(words(SHORT[kind], site_lang))
    blocks: list[list[tuple[str, int]]] = []

    def add(lines: list[str], label: int) -> None:
        blocks.append([(x, label) for x in lines])

    def chosen(table: dict[str, str], low: int, high: int) -> list[str]:
        own = words(table, site_lang)
        return rng.sample(own, min(len(own), rng.randint(low, high)))

    def menu() -> None:
        own, style = chosen(SECTIONS, 4, 7), rng.randrange(5)
        if style == 0:
            add([" · ".join(own)], 1)
        elif style == 1:
            add([f"- [{x}](/{x.lower()})" for x in own], 1)
        elif style == 2:
            add(["  ".join(own)], 1)
        elif style == 3:
            add(["| " + " | ".join(own) + " |", "|" + "---|" * len(own)], 1)
        else:
            add([" | ".join(f"[{x}](/{i})" for i, x in enumerate(own))], 1)

    def consent() -> None:
        lines = rng.sample(words(SHORT["consent"], site_lang), rng.randint(1, 2))
        if rng.random() < 0.2:
            lines.append(site + " " + rng.choice(words(SHORT["consent"], site_lang)).split(" ", 2)[-1])
        own = chosen(SHORT["buttons"], 1, 3)
        add(lines + (own if rng.random() < 0.6 else [" ".join(f"[{x}]" for x in own)]), 1)

    def related() -> None:
        head, style, n = short("related"), rng.randrange(3), rng.randint(3, 6)
        if style == 0:
            add([f"## {head}"], 1)
            add([f"- [{title()}](/p/{rng.randrange(9999)})" for _ in range(n)], 1)
        elif style == 1:
            add([f"**{head}**", *[f"* {title()} ({rng.choice(['2021-03-04', '04/03/2021', '2021年3月4日'])})" for _ in range(n)]], 1)
        else:
            add([f"{head}:", *[title() for _ in range(n)]], 1)

    def path(own: str) -> None:
        a, b = rng.sample(words(SECTIONS, site_lang), 2)
        add([rng.choice([f"{a} > {b} > {own}", f"[{a}](/) / [{b}](/{b.lower()})", f"{a} » {b} » {own}", f"{a} > {b}"])], 1)

    def share() -> None:
        own = chosen(SHORT["share"], 1, 2)
        add([" · ".join(own)] if rng.random() < 0.6 else own, 1)

    def foot() -> None:
        own, style = chosen(LEGAL, 3, 5), rng.randrange(4)
        year = rng.choice(["2021", "2019–2024"])
        if style == 0:
            add([*[f"- [{x}](/f{i})" for i, x in enumerate(own)], f"Copyright {year} {site}"], 1)
        elif style == 1:
            add([f"{site} – " + " – ".join(own)], 1)
        elif style == 2:
            add([*own, f"{site} 2021"], 1)
        else:
            add([f"© {year} {site}. {words(SHORT['end'], site_lang)[3]}", " | ".join(f"[{x}](/{i})" for i, x in enumerate(own))], 1)
        if rng.random() < 0.5:
            add([short("end")], 1)

    def body() -> None:
        kind = rng.random()
        if kind < 0.6:
            add([" ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))], 0)
        elif kind < 0.7:
            add([f"- {sentence()}" if rng.random() < 0.5 else f"{i + 1}. {sentence()}" for i in range(rng.randint(2, 5))], 0)
        elif kind < 0.8:
            cell = lambda: term() if rng.random() < 0.6 else f"{term()} {rng.choice(rng.choice(words(SHORT[rng.choice(['end', 'share', 'consent'])], lang)).split()).lower()}"
            add([f"| {term()} | mm | 41.2 |", "|---|---|---|", *[f"| {cell()} | mm | {rng.randrange(99)} |" for _ in range(rng.randint(2, 6))]], 0)
        elif kind < 0.9:
            add([f"> {sentence()}"], 0)
        else:
            add(["```ini", *[f"{term()}.a = {rng.randrange(9999)}" for _ in range(3)], "```"], 0)

    own = title()
    if rng.random() < 0.8:
        for part in rng.sample(["top", "menu", "tools", "consent", "path"], rng.randint(2, 5)):
            {"top": lambda: add([short("top")], 1), "menu": menu, "tools": lambda: add([short("tools")], 1), "consent": consent, "path": lambda: path(own)}[part]()
    if rng.random() < 0.2:
        related()
    if rng.random() < 0.85:
        add([f"# {own}"], 0)
    for _ in range(rng.randint(1, 5)):
        if rng.random() < 0.8:
            add([f"{'#' * rng.randint(2, 3)} {pick(art['head'])}"], 0)
        for _ in range(rng.randint(1, 3)):
            body()
        extra = rng.random()
        if extra < 0.08:
            add([short("ad")], 1)
        elif extra < 0.16:
            add([f"{words(READ, site_lang)[0]}: [{title()}](/p/{rng.randrange(9999)})"], 1)
        elif extra < 0.22:
            add([short("news")], 1)
        elif extra < 0.25:
            consent()
    if rng.random() < 0.25:
        add([f"## {pick(art['sources'])}"], 0)
        add([f"{i + 1}. [{title()}](https://{rng.choice(['rior', 'galor'])}.example/{rng.randrange(999)})" for i in range(rng.randint(2, 4))], 0)
    if rng.random() < 0.85:
        for part in [share, related, lambda: add([f"{rng.choice(words(TAGS, site_lang))}: " + ", ".join(term() for _ in range(3))], 1), lambda: add([short("news")], 1), consent, foot]:
            if rng.random() < 0.5:
                part()
    return [x for b in blocks for x in [*b, ("", -1)]]


def training_pages(n: int, seed: int = 7) -> list[list[tuple[str, int]]]:
    rng = random.Random(seed)
    return [training_page(rng) for _ in range(n)]


def training_titles(n: int, seed: int = 13) -> list[tuple[tuple[str, str | None, list[str]], int]]:
    """Captured titles with the page's own (or none) and its foot lines: 1 if the captured one holds more."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(ARTICLE))
        art = ARTICLE[lang]
        own = rng.choice(art["title"].split("|")).replace("{t}", rng.choice(art["terms"].split("|")))
        site = rng.choice(["Tor", "Har", "Sol"]) + rng.choice(["mir", "el", "wex"]) + " " + rng.choice(SITE_WORDS.split("|")[:4]) if lang != "zh" else rng.choice("溪岚霞槐") + rng.choice("砚泽川禾") + rng.choice(SITE_WORDS.split("|")[4:8])
        named = site if rng.random() < 0.8 else "Vorsel 7"
        a, b = rng.sample(words(SECTIONS, lang), 2)
        feet = [f"© 2021 {named}"] if rng.random() < 0.7 else []
        sep = rng.choice([" - ", " – ", " | ", " · ", " :: ", "_"])
        titled, more = rng.choice(
            [(own, 0), (own.upper(), 0), (f" {own}  ", 0), (own, 0), (f"{own}{sep}{named}", 1), (f"{own}{sep}{a} · {named}", 1), (f"{named}: {own}", 1), (f"({rng.randint(1, 9)}) {own}", 1), (f"({rng.randint(1, 9)}) {own}{sep}{named}", 1), (f"{a} » {b} » {own}", 1), (f"{a}{sep}{own}", 1)]
        )
        page = own if rng.random() < 0.7 else None if rng.random() < 0.7 else own.replace("e", "�", 1)
        if rng.random() < 0.1:  # the page was captured under another title, or in another way of writing
            page = rng.choice(art["title"].split("|")).replace("{t}", rng.choice(art["terms"].split("|")))
        out.append(((titled, page, feet), more))
    return out
