"""Stop words by language code, sorted by length; any order means the same."""

from __future__ import annotations

_LISTS = {
    "en": """
        a be if of an in on no to or as is at it by and the are for was not but such with will then into this that they there these their
    """,
    "en_extended": """
        a i t be he me re ve we if of ll am an in on do no so to up or as is us at it by my via had did and she the are off all him can ain don won isn own
        who too her per for nor our has was his its yet not but out you few how now may why any once same some here were more have each much with both will
        them whom from shan than hadn didn been then when aren upon hasn wasn down also into onto near over your does this hers ours that what most just must
        they only many very could would since while there where these those whose above being doing along among which until shall still needn weren haven
        again doesn mustn under other after their yours might ought about below every should behind beyond around toward before itself myself during having
        though couldn wouldn within mightn either theirs unless across because himself herself through shouldn between whether neither another further however
        against without yourself although ourselves themselves yourselves
    """,
    "fr": """
        c d j l m n s t y la ma sa ta ce de je le me ne se te il en on un et au du ou qu tu une que toi lui qui mon son ton par sur pas ces des les mes ses
        tes nos vos est aux eux avec elle même leur pour mais dans nous vous sont notre votre
    """,
    "de": """
        da ob am im um an in so wo er es du zu und die sie wie auf ich bei dem ihm zum man den ihn bin ein hin von nun war der wer ihr wir vor nur zur für das
        was des bis als uns aus hat mit ist sind wird jede alle jene ohne eine ihre eure nach sich doch noch auch euch weil will soll beim kein mein sein dann
        kann denn wenn also aber über oder hier euer sehr dies dass muss dort bist keine meine seine diese hatte welch durch jedem allem jenem einem ihrem
        eurem jeden allen jenen ihnen einen ihren euren jeder aller jener einer ihrer eurer unser etwas jedes jenes nicht damit einige welche andere unsere
        keinem meinem seinem diesem anderm keinen meinen seinen diesen andern wieder keiner meiner seiner dieser hinter anderr dieses anders einigem welchem
        anderem unserem einigen welchen anderen unseren einiger welcher anderer unserer einiges welches anderes allerdings
    """,
    "es": """
        a e o y ha la ya de he le me se te mi ni si ti al el en un ho lo no yo es os su tu mí tú sea una era esa mía ese fue que fui del han sin con son uno
        eso mío her ser por has las les mis los nos sus tus más hay hoy muy qué nada ella para otra esta ante este cual sean eran hubo poco todo algo como
        pero otro esto seas eras esas mías eres unos esos míos será seré hasta donde desde tiene sobre entre quien serán tengo mucho tanto tener ellas otras
        estas antes erais seáis todos ellos hemos otros estos serás contra porque tienen fueron cuando tienes tenéis seréis muchos seamos fuimos nuestra
        vuestra durante también nuestro vuestro algunas quienes tenemos seremos algunos nosotras vosotras nuestras vuestras nosotros vosotros nuestros
        vuestros
    """,
    "it": """
        a e i l o da fa ha la ma ed le se te ai ci di li mi ti vi al il in un ho io lo fu su tu mia una era fra tra sua tua che mie due sue tue dai hai dei
        lei sei chi gli noi poi voi cui fui lui qui sui dal del col sul fin con non mio uno suo tuo per alla ebbe come fare pure dove miei ogni suoi tuoi dell
        allo solo fino sono dopo loro però dalla della nella sulla prima aveva anche dalle delle nelle sulle avere altre oltre siete dagli degli sugli fuori
        altri tutti dallo dello nello sullo siamo fummo erano hanno altro verso tutto quella ancora allora vostra questa essere vostre queste quelli vostri
        questi quello furono ebbero dietro dentro contro nostro vostro adesso perché durante avevano
    """,
    "pt": """
        a e o à é da na de me se te em um ao do lo no as os às eu ou há já só ela uma era sua tua lhe ele que foi nem sem tem com num são ser ter for por das
        mas nas aos dos nos vos nós meu seu teu até dela pela numa para fora essa esta dele esse este qual eram quem tudo pelo como isso isto elas suas tuas
        lhes eles mais meus seus teus você minha nossa entre foram mesmo nosso muito delas pelas essas estas deles esses estes pelos fomos vocês aquela aquele
        também quando aquilo minhas nossas depois nossos aquelas aqueles
    """,
    "nl": """
        u ja na de ge je me te we ze of ik al om en in zo op er is nu uw heb had die wie hoe nog zei bij hij mij wij zij ook wil hem aan dan kan van ben een
        men hun der was als ons dus dat wat het met dit uit tot zou werd deze zelf zich doch toch veel geen doen toen mijn zijn daar haar maar naar meer hier
        over door voor eens iets niet moet want tegen komen waren wezen onder reeds alles niets omdat wordt heeft altijd iemand andere hebben worden kunnen
        zonder geweest
    """,
    "ru": """
        а в и к о с у я да за на об ее же не те из ли ни им он во до ко но по со то от ну их бы вы мы ты она эта под где нее уже мне все еще чье без или они
        при эти чей мой той как так был вам там тем чем том его оно кто что это вас нет вот них наш для моя чья была даже тоже если были либо него чего того
        надо было всех весь есть быть хотя когда более также такой всего может чтобы здесь однако только
    """,
    "ar": """
        ب ف ل و لا ما قد مع بل كل ثم لم هم أن إن عن لن من هن أو هو في هي جدا إذا هذا إلا كما أنا أنت حيث بعد عند غير ليس بعض فقط كيف تلك ذلك قال قبل أقل لأن
        كان نحن لكن أين حين هذه حتى متى إلى على قالت كانت أكثر أنتم تكون يكون التي الذي لماذا كانوا الذين اللاتي اللواتي
    """,
    "zh": """
        一 上 不 与 也 了 人 从 他 会 但 你 到 去 及 只 吗 吧 呢 和 哦 啊 嗯 在 她 好 它 对 就 并 很 我 或 把 是 有 用 的 看 着 而 被 要 说 还 这 那 都 一个 这个 那个 因为 什么 这些 那些 可以 所以 他们 你们 她们 我们 然后 自己 但是 就是 没有
        如果 虽然 已经
    """,
    "ja": """
        か が さ ぜ ぞ だ て で と な に ぬ ね の は へ も や よ ら わ を ん 一 三 二 何 俺 僕 君 彼 私 誰 たい ない どう なお しか だが いく おく だけ ここ そこ どこ もし です ます はず なぜ また ただ いつ ので まで けど など ほど のに あの この
        その どの ため かも でも から より ある いる くる する なる みる あれ これ それ どれ 彼女 らしい しまう もらう だろう たとえ あそこ しかし あなた そうだ ようだ いくつ そして として けれど ように ために さらに それに ながら いくら つまり できる あげる くれる
        ところ でしょう すなわち について なぜなら
    """,
    "ko": """
        가 겠 고 과 그 께 나 너 는 더 덜 도 또 로 를 만 며 면 았 었 에 와 은 을 의 이 저 좀 지 그것 이것 저것 에게 거기 여기 저기 그녀 ㄴ다 ㄹ다 같다 는다 되다 마다 보다 없다 이다 있다 하다 모두 처럼 으로 우리 정말 너무 이미 에서 예요 매우 가장 까지
        아직 조차 부터 한테 또한 저희 그리고 그러나 입니다 그런데 하지만 따라서 그래서 이에요
    """,
}
STOP_WORDS: dict[str, frozenset[str]] = {k: frozenset(v.split()) for k, v in _LISTS.items()}
