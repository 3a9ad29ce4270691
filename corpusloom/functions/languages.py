"""Stop words, endings and analysers by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.functions import stemming

# --- fixed values: stop words; endings in the order they are tried, a=b replacing a by b ---
STOP_BY_LANGUAGE = {
    "en": an.STOP_WORDS,
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y".split(),
    "de": "aber alle allem allen aller allerdings als also am an andere anderem anderen anderer anderes anderm andern anderr anders auch auf aus bei beim bin bis bist da damit dann das dass dem den denn der des die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer einige einigem einigen einiger einiges er es etwas euch euer eure eurem euren eurer für hat hatte hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer im in ist jede jedem jeden jeder jedes jene jenem jenen jener jenes kann kein keine keinem keinen keiner man mein meine meinem meinen meiner mit muss nach nicht noch nun nur ob oder ohne sehr sein seine seinem seinen seiner sich sie sind so soll und uns unser unsere unserem unseren unserer über um von vor war was weil welch welche welchem welchen welcher welches wenn wer wie wieder will wir wird wo zu zum zur".split(),
    "es": "a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era eras erais eran eres es esa esas ese eso esos esta estas este esto estos fue fueron fui fuimos ha han has hasta hay he hemos her ho hoy hubo la las le les lo los me mi mis mucho muchos muy más mí mía mías mío míos nada ni no nos nosotras nosotros nuestra nuestras nuestro nuestros o os otra otras otro otros para pero poco por porque que quien quienes qué se sea seáis seamos sean seas ser serás será seré seréis seremos serán si sin sobre son su sus también tanto te tenéis tenemos tener tengo ti tiene tienen tienes todo todos tu tus tú un una uno unos vosotras vosotros vuestra vuestras vuestro vuestros y ya yo".split(),
    "it": "a adesso ai al alla allo allora altre altri altro anche ancora avere aveva avevano che chi ci col come con contro cui da dagli dai dal dalla dalle dallo degli dei del dell della delle dello dentro di dietro dopo dove due durante e ebbe ebbero ed era erano essere fa fare fin fino fra fu fui fummo fuori furono gli ha hai hanno ho i il in io l la le lei li lo loro lui ma mi mia mie miei mio nella nelle nello noi non nostro o ogni oltre per perché poi prima pure però qui questa queste questi quello quelli quella quello se sei siamo siete solo sono su sua sue sugli sui sul sulla sulle sullo suoi suo te ti tra tu tua tue tuoi tuo tutti tutto un una uno verso vi voi vostra vostre vostri vostro".split(),
    "pt": "a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa essas esse esses esta estas este estes eu foi fomos for foram fora há isso isto já lhe lhes lo mais mas me mesmo meu meus minha minhas muito na nas nem no nos nós nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus só sua suas também te tem ter teu teus tua tuas tudo um uma você vocês vos à às é são".split(),
    "nl": "aan al alles als altijd andere ben bij daar dan dat de der deze die dit doch doen door dus een eens en er ge geen geweest haar had heb hebben heeft hem het hier hij hoe hun iemand iets ik in is ja je kan komen kunnen maar me meer men met mij mijn moet na naar niet niets nog nu of om omdat onder ons ook op over reeds te tegen toch toen tot u uit uw van veel voor want waren was wat we werd wezen wie wij wil worden wordt ze zei zelf zich zij zijn zo zonder zou".split(),
    "ru": "а без более бы был была были было быть в вам вас весь во вот все всего всех вы где да даже для до его ее если есть еще же за здесь и из или им их к как ко когда кто ли либо мне может мой моя мы на надо наш не него нее нет ни них но ну о об однако он она они оно от по под при с со так также такой там те тем то того тоже той только том ты у уже хотя чего чей чем что чтобы чье чья эта эти это я".split(),
    "ar": "من في على إلى عن مع هذا هذه ذلك تلك هو هي هم هن أنا أنت أنتم نحن كان كانت كانوا يكون تكون قد قال قالت لا لم لن ليس إن أن لأن حتى إذا عند بعد قبل حين ثم أو و ف ب ل كل بعض غير أكثر أقل جدا فقط حيث كيف متى أين ما من لماذا التي الذي الذين اللواتي اللاتي كما لكن بل إلا".split(),
    "zh": "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 它 他 她 我们 你们 他们 她们 什么 这个 那个 这些 那些 但 但是 因为 所以 如果 虽然 然后 还 只 就是 已经 可以 对 把 被 从 用 而 与 及 或 并 啊 吧 呢 吗 嗯 哦".split(),
    "ja": "は が を に で と も の へ や か な ね よ わ ぞ ぜ さ ら て から まで より ので のに けど けれど ながら ところ ため だけ しか ほど など だ です ます ない ぬ ん たい らしい ようだ そうだ だろう でしょう かも はず いる ある する なる できる もらう あげる くれる おく みる しまう いく くる これ それ あれ この その あの ここ そこ あそこ 私 僕 俺 彼 彼女 あなた 君 また そして しかし でも だが ただ また さらに それに なお つまり すなわち なぜなら もし たとえ ように ために について として 一 二 三 何 どの どれ どこ 誰 いつ どう なぜ いくつ いくら".split(),
    "ko": "이 가 을 를 은 는 의 에 에서 로 으로 와 과 도 만 까지 부터 에게 한테 께 처럼 보다 마다 조차 이다 입니다 이에요 예요 았 었 겠 ㄴ다 는다 ㄹ다 지 고 며 면 나 저 너 그 그녀 우리 저희 이것 그것 저것 여기 거기 저기 그리고 그러나 하지만 그래서 따라서 그런데 또한 또 아직 이미 정말 매우 너무 좀 더 덜 가장 모두 있다 없다 하다 되다 같다 보다".split(),
}
ENDINGS = {
    "es": [
        "amientos imientos amiento imiento aciones ución uciones ación idades idad mente ismos ismo istas ista ibles ible ables able",
        "ándose iéndose ándome ando iendo aron ieron adas idas ados idos ada ida ado ido aban ían arán erán irán aré eré iré amos emos imos abas aba ías ía ar er ir",
        "os as es o a",
    ],
    "it": [
        "azioni azione amenti amento imenti imento ità mente ismi ismo isti ista ibili ibile abili abile",
        "andosi endosi ando endo arono erono irono ati ute uti ite iti ate ato uta uto ita ito avano evano ivano anno erei irei arsi ersi irsi are ere ire",
        "osi ose i e a o",
    ],
    "pt": [
        "amentos imento amento imentos ações ação idades idade mente ismos ismo istas ista áveis ável íveis ível",
        "ando endo indo aram eram iram adas idas ados idos ada ida ido ado avam amos emos imos ava ias ia ar er ir",
        "os as es o a",
    ],
    "nl": [
        "heden=heid heid ingen ing lijk baar zaam ster achtig erij isme ist",
        "enden ende tten=t dden=d ten den tte=t dde=d te de",
        "eren ens ers en es s",
    ],
    "ru": [
        "ывшись ившись ывши ивши вшись вши",
        "ться тся",
        "ующего ующему ующими ующих ующим ующей ующую ующее ующие ующий ующая ованного ованному ованными ованных ованным ованной ованную ованное ованные ованный ованная ованно ованн ого ому ыми ими ых их ым им ей ой ую ые ие ый ий ая яя",
        "ывайте ивайте ывать ивать ываю иваю овать евать уйте ейте ите ешь ишь ают яют ют ут ал ял ала яла али яли ать ять ить",
        "ости ость ений ения ению ение аний ания анию ание ами ями ах ях ам ям ов ев ей ий ая яя ом ем и е а я ы у ю",
        "ость ь",
    ],
}
# --- end of fixed values ---


def _stemmer(language: str, **options):
    return an.suffix_stemmer([an.ending_rules(step) for step in ENDINGS[language]], **options)


# --- fixed values: Arabic articles, then single letters, before a word; endings behind it ---
ARABIC_FRONT = ("وال بال كال فال ال", "و ف ب ل ك س")
ARABIC_END = "تين ين ون ات ان تا ية يا ها هم هن كم نا ني تم تن ة ت ي ا"
# --- end of fixed values ---


def stem_arabic(word: Column) -> Column:
    """One article and one letter go from the front if three letters remain, one ending if two do."""
    out = word
    for front in ARABIC_FRONT:
        out = F.regexp_replace(out, f"^(?:{'|'.join(front.split())})(?=.{{3,}}$)", "")
    out = F.regexp_replace(out, f"^(.{{2,}}?)(?:{'|'.join(ARABIC_END.split())})$", "$1")
    return F.when(F.length(word) <= 2, word).otherwise(out)


STEMMERS = {
    "ar": stem_arabic,
    "fr": an.stem_french,
    "de": an.stem_german,
    "es": _stemmer("es", guard=3),
    "it": _stemmer("it", guard=3),
    "pt": _stemmer("pt", guard=3),
    "nl": _stemmer("nl", guard=3, drop_last="e", drop_above=3),
    "ru": _stemmer("ru", guard=2, shortest=2),
}


def language_analyser(language: str, stop_words: list[str] | None = None) -> an.Tokens:
    """Tokeniser, lower case, stop words and stemmer of a language, by its primary tag.

    Korean, Chinese and Japanese are cut into pairs of characters and not stemmed. Raises ValueError for a language that
    isn't known, unless stop words are given: then it is analysed with them and without a stemmer.
    """
    code = language.split("-")[0].lower()
    stops = stop_words if stop_words is not None else STOP_BY_LANGUAGE.get(code)
    if stops is None:
        raise ValueError(f"language {language!r} isn't known; known are {', '.join(sorted(STOP_BY_LANGUAGE))}")
    if code in ("zh", "ja", "ko"):
        return an.analyser(an.cjk_bigrams, an.lowercase, an.stop(stops))
    filters = [an.lowercase]
    if code == "fr":
        filters.append(an.elision())
    filters.append(an.stop(stops))
    if code == "en":
        filters.append(stemming.word_filter(stemming.porter))
    elif code in STEMMERS:
        filters.append(an.each(STEMMERS[code]))
    return an.analyser(an.words, *filters)
