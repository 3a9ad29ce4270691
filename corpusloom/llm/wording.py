"""Whether a message template speaks of failure, of something the visitor must do, or of text yet to come.

No phrases are listed. A small lexicon (a parameter) maps word stems of some languages to concepts; a message says
residue if its words make up one of a few frames of concepts (a thing that can't be found, a script that must be switched
on, a part of a text that is still to come) and if little else is said: the words outside the lexicon and the function
words must be outweighed by those that carry the frame. "The session has three parts" has no frame, and "try again with
a smaller batch size" says more than a frame does. Besides, words that aren't words (one letter repeated, a run of keys,
the same word over and over) are filler in any language.

This is one weak feature among others: ``residue`` decides templates by it and by their company in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from corpusloom.functions.languages import STOP_BY_LANGUAGE

#: concept -> stems, folded to plain letters; a stem of up to three letters, or with a colon, is a whole word, a longer one a beginning.
LEXICON = {
    "thing": "page pages site website webpage url link address file resource document article request server service connection session account application app gateway backend host host: database folder view content "
    "seite datei dokument adresse anfrage dienst verbindung sitzung inhalt anwendung konto fichier ressource requete connexion application demande pagina archivo recurso documento direccion solicitud servidor servicio conexion sesion "
    "indirizzo richiesta servizio connessione sessione risorsa arquivo recurso servico conexao sessao endereco bestand verzoek verbinding sessie sida sidan tjanst side siden fil filen tjeneste sivu sivua palvelu tiedosto istunto stron plik zasob uslug serwer sesja sesji "
    "strank stranka stranka: soubor sluzb oldal szolgaltatas sayfa dosya sunucu hizmet oturum baglanti страниц файл ресурс документ адрес запрос сервер сервис служб сеанс сесси соединени сторінк σελιδ laman halaman",
    "find": "here permission permitted rights allowed authori berechtig permiso permess permiss droits uprawnie find found exist locat reach display available open connect fetch load gefund vorhanden auffind existiert erreichbar verfugbar geladen trouv existe disponib encontr hallad encontrad trovat disponib gevonden bestaat beschikba bereikba hittad hittas finns tillganglig fundet funnet findes finnes "
    "loyd loydy loytyn loyt saatavilla znalezion znalezc istniej dostepn nalezen nebyla existuje dostupn talalhat szukasz elerhet bulun найден существ доступ знайден βρεθηκε ditemukan tersedia",
    "neg": "not no non cannot cant can't couldn't could't doesn't don't didn't isn't wasn't won't without unable never nothing nicht kein keine keinen keiner ne n pas plus aucun aucune sin nao nada niet geen inte ingen ikke ei eivat nie ne nem yok не нет немає δεν tidak",
    "fail": "closed withdrawn missing gone removed deleted moved unavailable down offline denied deny forbidden unauthori expired expire failed failure fail error errors wrong sideways broken invalid refused rejected blocked block problem sorry oops uh-oh whoops hmm unexpected exception unhandled maintenance overload timeout timedout disabled unsupported outdated interrupted bad ended lost lack "
    "inexistant introuvable erreur interdit refus expire indisponible momentanement panne fehler fehlgeschlagen verweigert abgelaufen gesperrt abgeschaltet deaktiviert serverfehler wartung unerwartet gestort prohibid denegad caducad error inesperad desactiv bloque bloqu expirad inexist negad errore vietat negat scadut imprevist disattivat erro indisponiv verlopen fout geweigerd storing fel fejl feil virhe evatty blad odmow wygas "
    "chyb odepren hiba lejart hata reddedi gecersiz suresi doldu bulunamadi ошибк запрещ недоступ истек неполадк отключен помилк σφαλμα kesalahan ditolak went gateway overloaded suspended reset redirects many",
    "ask": "please try again retry once reload refresh login signin wait come return check contact verify verifying confirm continue proceed later moment moments soon click tap press minutes seconds loading slow administrator bitte versuchen erneut spater laden warten wenden anmelden veuillez reessay rechargez patient connecter ulterieur plus tard intente intentelo inicie vuelva espere cargar tarde "
    "riprova ricarica attend accedi tardi tente novamente recarreg aguarde tarde probeer opnieuw later vernieuw forsok igen senare ladda provaa prov igen senere ladda yrita uudelleen myohemmin sprobuj ponownie pozniej zkuste znovu pozdeji probalja ujra kesobb lutfen tekrar deneyin повторите попытк обновите пожалуйста попробуйте позже silakan coba lagi",
    "script": "javascript js script: scripts scripting noscript cookie cookies browser captcha human robot adblock skript skripte navigateur navegador navigatore javascripts blocker webbrowser webblasare przegladark tarayici браузер скрипт",
    "need": "necesita necesario nodig nodvand need needs needed require required requires must enable enabled enabling allow turn switch activate on off run runs work works working supported support use show shown see aktivieren erlauben einschalten braucht benotigt erforderlich nutzen anzeigen sehen activez activer autoris necessit requiert requis afficher utiliser active activar habilit permita necesita requiere requiere ver usar attiva abilit consent richied necess vedere usare ative habilite permita precisa requer ver usar "
    "activeer inschakel vereist nodig aktivera tillat kravs aktiver tillad wlacz włącz wymag aktywuj povolte zapnete vyzaduj engedelyez szukseges etkinlestir gerekl включите разрешите требуется нужен upgrade update",
    "part": "title titel titre titulo titolo titulu heading headline subheading sub caption text texte texto testo text: tekst content body copy paragraph paragraphe parrafo paragrafo absatz abschnitt section block box column tagline slogan description blurb summary legend image picture figure line row sentence space placeholder words chapeau legende inhalt uberschrift bildunterschrift beschreibung contenu contenido descripcion encabezado descrizione titul descricao legenda conteudo paragrafo текст заголовок описание абзац rubrik beskrivning naglowek opis baslik metin",
    "pending": "here come comes go goes later delivered supplied provided insert inserted placed replace edit replaced add written write appear tbd tba follow follows coming fill filled stand stands sample example dummy mock mockup filler placeholder provisional layout "
    "hier kommt folgt spater einfugen steht stehen ersetzen platzhalter beispiel muster fullung dient viendra remplacer completer ici exemple reecrire faux maquette aqui ira pendiente redactar sustituya relleno ejemplo insertar provisional inserire segnaposto qui andra finale definitivo completare prova esempio sostituire inserir vira substituir exemplo preencher здесь будет образец пример заполните har kommer ersatt tutaj bedzie burada gelecek",
    "mock": "lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua blah bla tk blindtext mustertext filltext loremipsum dummytext fulltext",
    "slight": "http status code requested request tried processing process building typing looking side end now right time times temporarily currently this that internal unknown properly permission rights authori allowed lack address limit rate access "
    "momentan occur happen aufgetreten produit produc verificat ocorr derzeit moment diese dieser dieses dem ihrem ihre berechtigung interner vorubergehend zugriff momento este esta acces acceso accesso acesso permiso permissao permesso interno interna interne inattendue tillfalligt access tilladelse dostep pristup erisim доступ date out "
    "client designer editors editor author team thing something origin upstream own short long new own block words more less point item one two three numero bad data link refused",
    "nav": "reference id trace incident ir hem home docs search about menu help back start map terms contact skip privacy legal imprint impressum kontakt startseite handbuch suche zuruck springen springe accueil guides recherche aller contenu mentions legales inicio guias buscar aviso contacto volver cookies rights reserved all copyright login menu suche hjem hem strona glowna главная меню контакты previous next top share print guide",
}
#: The least share of a message's words that must carry its frame, where they carry a frame of little and of much evidence.
LEAST_COVER, LEAST_COVER_STRONG = 0.65, 0.5
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
STATUS = re.compile(r"[45]\d\d")

WORD = re.compile(r"[45]\d\d|[^\W\d_]+(?:['’\-][^\W\d_]+)*|<\*>")
EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
EAST_CONCEPTS = {
    "thing": "页面 网页 文件 资源 服务 链接 请求 会话 网站 地址 頁面 ページ サーバー サービス リクエスト セッション ファイル アドレス サイト 페이지 서버 서비스 요청 세션 파일",
    "fail": "找不到 未找到 不存在 不可用 无法 错误 失败 拒绝 过期 禁止 已被删除 維護 维护 見つかり エラー 失敗 拒否 利用できません 期限切れ 存在しません 禁止 찾을 없습니다 오류 실패 거부 만료",
    "ask": "请 稍后 重试 再试 刷新 登录 再度 もう一度 お試し 後ほど しばらく ください 再読み込み ログイン 다시 시도 나중에 새로고침 로그인",
    "script": "脚本 浏览器 ブラウザ スクリプト 브라우저 스크립트 자바스크립트",
    "need": "启用 开启 需要 允许 表示する 显示 有効 許可 必要 オン 활성화 허용 필요 사용",
    "part": "标题 正文 内容 文字 文本 段落 图片 タイトル 本文 見出し テキスト 文章 画像 제목 본문 내용 텍스트",
    "pending": "示例 此处 这里 填写 替换 占位 待定 ダミー サンプル ここに 入ります 仮 置き換え 여기에 예시 입력",
}
_NAMES = tuple(LEXICON)
_BIT = {n: 1 << i for i, n in enumerate(_NAMES)}
THING, FIND, NEG, FAIL, ASK, SCRIPT, NEED, PART, PENDING, MOCK, SLIGHT, NAV = (_BIT[n] for n in _NAMES)
FUNCTION, ODD, CODE = 1 << 20, 1 << 21, 1 << 22
TELLING = THING | FIND | NEG | FAIL | ASK | SCRIPT | NEED | PART | PENDING | MOCK | CODE
_MORE_FUNCTION_WORDS = (
    "haben habe hast hat i you your yours we our us he she they them his her can could may might should would do does did has have had been being were am me my from who what which when where why how so than too "
    "very just about over after before more most other some any all each every own same there also only while during because until between through its it's we're you're let up der die das zum zur vom dans avec cette cet votre vos sur sous sans ihr ihre ihren su sus este il lo una del con para por que mit"
).split()
FUNCTION_WORDS = {w for lang in ("en", "fr", "de", "es", "it", "pt", "nl", "ru") for w in STOP_BY_LANGUAGE[lang]} | set(_MORE_FUNCTION_WORDS)


def fold(word: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("’", "'").replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("ı", "i").replace("đ", "d")) if not unicodedata.combining(c))


def _tables() -> tuple[dict[str, int], dict[str, int]]:
    whole, begin = {}, {}
    for name, stems in LEXICON.items():
        for s in stems.split():
            at, s = (whole, fold(s.rstrip(":"))) if len(s) <= 3 or s[-1] == ":" else (begin, fold(s))
            at[s] = at.get(s, 0) | _BIT[name]
    return whole, begin


_WHOLE, _BEGIN = _tables()
_EAST = [(w, _BIT[name]) for name, ws in EAST_CONCEPTS.items() for w in ws.split()]


def _odd(w: str) -> bool:
    if len(set(w)) == 1 and len(w) >= 2:
        return True
    return len(w) >= 4 and any(w in row or w[::-1] in row for row in KEY_ROWS)


@lru_cache(maxsize=1 << 16)
def concepts(word: str) -> int:
    """The concepts of a word, as bits."""
    if STATUS.fullmatch(word):
        return CODE
    plain = fold(word)
    bits = _WHOLE.get(plain, 0)
    for k in range(len(plain), 3, -1):
        if plain[:k] in _BEGIN and len(plain) - k <= 4:
            bits |= _BEGIN[plain[:k]]
            break
    if word in FUNCTION_WORDS or plain in FUNCTION_WORDS:
        bits |= FUNCTION
    if not bits and plain.endswith("n't"):
        bits = NEG
    if not bits and _odd(plain):
        bits = ODD
    return bits


_PROSE = re.compile(r"(?:[^\W\d_]|[\s.,;:!?'’-])+")
_TRACE = re.compile(r"at [\w.$<>]+\(.*\)")
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»')
_PLAIN = re.compile(r"[45]\d\d|[a-z]{2,}")
QUOTES = frozenset("\"“„«")
_JOINED = re.compile(r"\b(sign|log|time|timed)[ -](in|out)\b")
RESIDUE, NEUTRAL, MADE_UP, OPEN = "residue", "neutral", "made up", "open"
_CODE = re.compile(r"[;{}=]|\(\)")
_LABEL = re.compile(r"[^\W\d_]+(?:[ -][^\W\d_]+){0,2}\W{0,3}\*\W*")


def _frame(has: int, n: int) -> int:
    """0 no frame, 1 a frame, 2 a frame with more evidence beside it."""
    failing = bool(has & FAIL) or bool(has & NEG and has & FIND)
    got = 0
    if has & CODE and (failing or n <= 3):
        got = 2
    if failing and has & (THING | SLIGHT | ASK | SCRIPT | CODE):
        got = max(got, 2 if has & NEG and has & THING or has & ASK or has & CODE else 1)
    if failing and n <= 3:
        got = max(got, 1)
    if has & SCRIPT and has & (NEG | FAIL | NEED | ASK):
        got = max(got, 2 if has & ASK or has & NEG or has & THING and has & NEED else 1)
    if has & PART and has & PENDING:
        got = max(got, 1)
    if has & MOCK:
        got = max(got, 1)
    return got


def judge(message: str, words: list[str] | None = None) -> tuple[str, list[str]]:
    """What a masked message says by itself, and its words (of made-up candidates only).

    residue: a frame, and little besides; neutral: navigation, labels with codes, nothing but codes and signs; made up:
    four words or more and no function word, which the corpus has to decide; open: anything else.
    """
    if EAST.search(message):
        has, covered = 0, 0
        for w, bit in _EAST:
            if w in message:
                has |= bit
                covered += len(w)
        for w in _PLAIN.findall(message):
            has |= concepts(w) & ~FUNCTION
        total = len(EAST.findall(message))
        frame = _frame(has | (THING if has & FAIL and covered * 2 >= total else 0), 9)
        return (RESIDUE if (frame or has & ASK and has & FAIL or has & ASK and covered * 2 >= total) and covered * 10 >= total * 4 else OPEN), []
    if message.startswith("at ") and _TRACE.match(message):
        return NEUTRAL, []
    if not QUOTES.isdisjoint(message):
        outside = _QUOTED.sub(" ", message)
        if outside != message and len(WORD.findall(outside)) >= 3:
            message, words = outside, None
    if _JOINED.search(message):
        words = WORD.findall(_JOINED.sub(lambda m: m[1] + m[2], message))
    elif words is None:
        words = WORD.findall(message)
    if not words:
        return NEUTRAL, []
    has = asks = told = own = nav = odd = functions = 0
    for w in words:
        b = concepts(w)
        has |= b
        if not b:
            own += 1
        elif b == FUNCTION:
            functions += 1
        else:
            asks += b & ASK != 0
            odd += b & ODD != 0
            functions += b & FUNCTION != 0
            told += b & TELLING != 0
            nav += b & NAV != 0
    n = len(words)
    if n >= 12 and told * 2 < own and functions and not odd:
        # too much else is said for any frame
        return OPEN, []
    lengthy = [w for w in words if len(w) >= 2]
    if odd * 2 >= n or (len(lengthy) >= 2 and len(set(lengthy)) * 2 <= len(lengthy)) or (odd and odd + told == n):
        return RESIDUE, []
    if "*" in message and _LABEL.fullmatch(message) and not has & (FAIL | CODE):
        return NEUTRAL, []
    if own == 0 and (nav and n <= 8 or n <= 2) and not message.endswith(("...", "…")) and not has & (FAIL | NEG | CODE | SCRIPT | PENDING | MOCK):
        return NEUTRAL, []
    frame = _frame(has, told + own)
    if has & PENDING and own == 0 and n <= 4:
        frame = max(frame, 1)
    if asks >= 2 or asks and has & THING:
        frame = max(frame, 1)
    if asks and n <= 3 and message.endswith(("...", "…")):
        frame = max(frame, 1)
    share = told / (told + own) if told + own else 0.0
    if frame and not _CODE.search(message) and share >= (LEAST_COVER_STRONG if frame == 2 else LEAST_COVER):
        return RESIDUE, []
    if n >= 4 and not functions and _PROSE.fullmatch(message) and all(len(w) >= 3 for w in words):
        return MADE_UP, sorted({fold(w) for w in words})
    return OPEN, []
