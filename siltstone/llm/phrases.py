"""Fixed values that several operators share: function words by language, filler, messages."""

from __future__ import annotations

# Function words as published stop-word lists have them, the most frequent of each
# language. NOMINAL ones stand inside noun phrases (articles, "and", "of"), so titles, lists and tables
# have them as well; the others tie clauses together.
NOMINAL = {
    "en": "the a an and or of",
    "de": "der die das den dem des ein eine einen einem einer eines und oder vom",
    "fr": "le la les l un une des du de d et ou",
    "es": "el la los las un una unos unas de del y o",
    "pt": "o a os as um uma uns umas de do da dos das e ou",
    "nl": "de het een en of van der",
    "it": "il lo la i gli le un uno una di del della dei delle degli dello e o",
    "sv": "en ett och eller den det de",
    "da": "en et og eller den det de",
    "no": "en ei et og eller den det de",
}
CLAUSAL = {
    "en": "to in is are was were be been it its that this these those for with on as at by not from than but we they you i he she his her their our my your has have had do does did who which what when where if so more most there can could will would should may must after before over under into about because while how why no nor only both each such then until without between near every never all one says said",
    "de": "ist sind war waren wird werden wurde hat haben hatte kann können muss soll nicht auch noch nur schon sich sie er es wir ihr ich man mit auf für von im in an am zu zum zur bei nach aus um über unter durch vor ohne seit bis gegen zwischen dass ob wenn weil als wie was wer wo so aber denn sehr mehr alle alles viele kein keine niemand ihre ihren seine diese dieser dieses",
    "fr": "est sont était étaient être a ont avait fait peut doit ne pas plus que qui dans pour par sur avec sans sous entre vers chez ce cet cette ces se son sa ses leur leurs nous vous ils elle elles il on je au aux en y comme mais donc si quand où depuis avant après très tout tous toute personne aucun rien aussi même encore alors ainsi ensuite abord seulement",
    "es": "es son era eran está están fue ser ha han había hace puede debe no que quien en para por con sin sobre entre hasta desde se su sus lo le les al nos yo él ella ellos este esta estos estas ese esa como más pero si cuando donde porque aunque muy todo todos cada nadie nada tampoco también solo ya aún después antes mi mis tu tus",
    "pt": "é são era eram está estão foi ser tem têm havia faz pode deve não que quem em no na nos nas para por com sem sobre entre até desde se seu sua seus suas ao aos pelo pela ele ela eles elas nós este esta isso como mais mas quando onde porque embora muito tudo todos cada ninguém nada também só já ainda depois antes",
    "nl": "is zijn was waren wordt worden werd heeft hebben had kan kunnen moet zal niet ook nog maar al alleen zich ze hij zij wij we je u ik men er met op voor in aan te tot bij naar uit om over onder door zonder sinds tussen dat die dit deze als wie wat waar toen hoe want dan zo veel alle alles geen niemand hun haar onze na sommige",
    "it": "è sono era erano essere ha hanno aveva fa può deve non che chi cui in per con su tra fra da dal dalla al alla ai nel nella sul sulla si suo sua suoi loro lui lei noi questo questa questi quello come più ma se quando dove perché anche molto tutto tutti ogni nessuno niente già ancora solo dopo prima senza fino",
    "sv": "är var blir blev har hade kan ska skulle måste inte att som på i av för med till från om men så när där hur han hon vi de jag ni man sig sin sina mycket alla ingen bara också efter innan utan mellan under över",
    "da": "er var bliver blev har havde kan skal skulle må ikke at som på i af for med til fra om men så når hvor han hun vi jeg man sig sin sine meget alle ingen kun også efter før uden mellem under over",
    "no": "er var blir ble har hadde kan skal skulle må ikke å at som på i av for med til fra om men så når hvor han hun vi jeg man seg sin sine mye alle ingen bare også etter før uten mellom under over",
}
# Unambiguous words of the printer's passage, and other text that only fills a space.
FILLER_WORDS = "lorem ipsum consectetur adipiscing eiusmod incididunt aliqua veniam nostrud exercitation ullamco laboris aliquip reprehenderit cillum fugiat pariatur excepteur occaecat cupidatat proident deserunt laborum blah placeholder"
UNFILLED = r"\{\{|\}\}|\$\{|\{\$|\{%|<%|%>|#\{|\{[0-9]\}|\[\[|\]\]|@@[A-Z]|\*\||\|\*|__[A-Z]|%[A-Z]{3,}%|\[object |\[(?:insert|your|tbd|todo)\b|<<[a-z]|\bundefined\b|\bxxx-|sample text|goes here|^todo:"
# Phrases of error pages and script notices.
ERRORS = (
    r"not found|page introuvable|nicht gefunden|no encontrada|não encontrada|non trovata|niet gevonden|access denied|permission denied|forbidden|accès refusé|zugriff verweigert|acceso denegado|acesso negado|accesso negato|toegang geweigerd|"
    r"internal (?:server )?error|erreur interne|interner fehler|error interno|erro interno|errore interno|interne fout|bad gateway|service unavailable|gateway timeout|too many requests|session has expired|no longer available|something went wrong|try again (?:in|later)|fatal error|error establishing|"
    r"down for (?:planned|maintenance)|you are (?:a )?human|^[45]\d\d$|^(?:oops|whoops)\b"
)
SCRIPTS = r"\bjavascript\b|\bscripting\b|(?:turn on|support|enable|allow) scripts|scripts activ|scripts ativ|script attiv|eingeschalteten skripten|scripts ingeschakeld"
