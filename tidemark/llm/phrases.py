"""The automaton's patterns: words and phrases by slot, in eleven languages, and phrases built from slots by rule.

A line is residue when the slots it fills form one of the frames in ``residue.frame`` and its words are covered. No whole sentence
is listed: an error message is a thing a reader asked for (``thing``) with what befell it (``fate``), a prompt is an order (``order``) with
what is to be put in (``blank``) and where (``spot``), a script notice names scripts (``script``) and that they are needed (``need``).
"""

from __future__ import annotations

from functools import cache
from itertools import product

#: Fates of a thing that are told in one word order or another: built from these parts.
_UNABLE = "could not|cannot|can not|can't|couldn't|can’t|couldn’t|could not be|cannot be|can not be|can't be|couldn't be|unable to|was unable to|were unable to|failed to|did not|does not|didn't|doesn't|won't|isn't|isn’t|is not|aren't|not"
_DONE = "load|loaded|open|opened|find|found|display|displayed|render|rendered|show|shown|reach|reached|process|processed|connect|complete|completed|build|built|read|serve|served|retrieve|retrieved|access|accessed|answer|answered|respond|exist|start|verify|locate|located|handle|handled|finish|fetch|fetched|work|working|available|responding|supported|accessible|allowed|permitted|authorized"
_BEEN = "has|have|was|were|has been|have been|may have been|might have been|could have been|is|are|had"
_GONE = "expired|removed|moved|deleted|renamed|blocked|refused|denied|suspended|rejected|reset|closed|disabled|archived|withdrawn|unavailable|temporarily unavailable|currently unavailable|not available|no longer available|not found|unreachable|overloaded|offline|private|too large|too big|not allowed|not permitted|not authorized|not authorised|restricted|interrupted|corrupt|damaged|invalid|not supported"
_GERMAN = "geladen|gefunden|geöffnet|angezeigt|verarbeitet|erreicht|hergestellt|abgerufen|gelesen|erstellt|verfügbar"
_FRENCH = "introuvable|inaccessible|indisponible|momentanément indisponible|temporairement indisponible|supprimé|supprimée|déplacé|déplacée|expiré|expirée|refusé|refusée"
_SPANISH = "encontrado|encontrada|encontrar|disponible|cargar|cargado|procesar|abrir|mostrar|acceder|completar|conectar|responder"
_PORTUGUESE = "encontrado|encontrada|encontrar|disponível|carregar|carregado|processar|abrir|mostrar|acessar|conectar|responder"
_ITALIAN = "trovato|trovata|trovare|disponibile|caricare|caricato|aprire|visualizzare|elaborare|raggiungibile|accessibile"
_DUTCH = "gevonden|geladen|beschikbaar|geopend|weergegeven|bereikbaar|verwerkt|bereikt"


def _joined(*slots: str, by: str = " ") -> str:
    return "|".join(by.join(words) for words in product(*(s.split("|") for s in slots)))


#: slot -> phrases, parted by bars; a line per language or rule.
SLOTS: dict[str, list[str]] = {
    # what befell it; a reason that stands for itself, in the words of servers and viewers
    "reason": [
        "bad gateway|gateway timeout|gateway time-out|bad request|internal server error|server error|access denied|permission denied|access forbidden|service unavailable|temporarily unavailable|too many requests|too many redirects|not found|request timeout|request timed out|connection timed out|connection refused|connection reset|connection error|connect error|reset reason|out of memory|no such page|web server is down|bad response|unknown error|unexpected error|fatal error|application error|network error|origin error|ssl handshake failed|dns error",
        "went wrong|an error occurred|an error has occurred|error occurred|something broke|something is broken|under maintenance|planned maintenance|scheduled maintenance|down for maintenance|undergoing maintenance|rate limit|request limit|quota exceeded|limit exceeded|session expired|link expired|checking your browser|verify you are human|verify that you are human|verifying you are human|are you a robot|complete the captcha|ddos protection|only members|members only|only subscribers|subscribers only|sign in again|login required|authentication required|no permission|no rights|not authorized to|not allowed to view|failed to load|are a human|not a robot|entity too large|payload too large|uri too long|internal error|misconfiguration|disable any ad blocker|ad blocker",
        _joined("error", "rendering|loading|opening|establishing|connecting|reading|fetching|retrieving|processing|parsing|displaying|saving|creating"),
        "seite nicht gefunden|nicht gefunden|fehler aufgetreten|fehler ist aufgetreten|existiert nicht|zugriff verweigert|zugang verweigert|zeitüberschreitung|interner serverfehler|ungültige anfrage|zu viele anfragen|wartungsarbeiten|wegen wartung|keine berechtigung|nicht verfügbar|nicht erreichbar|etwas ist schiefgelaufen|ist schiefgelaufen|ist abgelaufen",
        "n'existe pas|n’existe pas|n'existe plus|page introuvable|introuvable|momentanément indisponible|temporairement indisponible|une erreur s'est produite|erreur est survenue|erreur s'est produite|accès refusé|accès interdit|erreur interne|trop de requêtes|en maintenance|délai dépassé|a expiré|s'est mal passé",
        "no encontrada|no encontrado|no se encontró|no existe|acceso denegado|acceso prohibido|error interno|error del servidor|demasiadas solicitudes|en mantenimiento|ha ocurrido un error|se produjo un error|se ha producido un error|ocurrió un error|algo salió mal|ha caducado|ha expirado|tiempo de espera agotado|no está disponible",
        "não encontrada|não encontrado|não existe|acesso negado|acesso proibido|erro interno|erro no servidor|erro ao carregar|muitas solicitações|em manutenção|ocorreu um erro|algo deu errado|expirou|tempo esgotado|não está disponível|indisponível",
        "non trovata|non trovato|non esiste|accesso negato|accesso vietato|errore interno|errore del server|troppe richieste|in manutenzione|si è verificato un errore|qualcosa è andato storto|è scaduta|è scaduto|non disponibile|tempo scaduto|impossibile caricare|impossibile trovare|impossibile aprire",
        "niet gevonden|bestaat niet|toegang geweigerd|geen toegang|interne serverfout|te veel verzoeken|in onderhoud|er is een fout opgetreden|fout opgetreden|iets ging mis|er ging iets mis|is iets misgegaan|is verlopen|niet beschikbaar|tijdelijk niet beschikbaar",
        "не найдена|не найден|не найдено|не существует|доступ запрещен|доступ запрещён|отказано в доступе|внутренняя ошибка сервера|ошибка сервера|произошла ошибка|что-то пошло не так|слишком много запросов|временно недоступен|временно недоступна|недоступна|недоступен|техническое обслуживание|технические работы|истекла|истёк|истек|не удалось загрузить|не удалось открыть|не удалось найти",
        "nie znaleziono|nie istnieje|nie została znaleziona|nie został znaleziony|odmowa dostępu|brak dostępu|brak uprawnień|błąd serwera|wewnętrzny błąd serwera|wystąpił błąd|coś poszło nie tak|zbyt wiele żądań|niedostępna|niedostępny|przerwa techniczna|wygasła|wygasł|nie można załadować|nie udało się załadować",
        "見つかりません|見つかりませんでした|存在しません|アクセスが拒否|アクセスできません|内部サーバーエラー|サーバーエラー|エラーが発生しました|問題が発生しました|メンテナンス中|利用できません|読み込めません|読み込めませんでした|表示できません|有効期限が切れ|期限切れ|リクエストが多すぎ|権限がありません",
        "不存在|未找到|找不到|无法加载|无法打开|无法显示|无法访问|无法连接|内部错误|服务器错误|发生错误|出错了|出现错误|访问被拒绝|拒绝访问|没有权限|请求过多|维护中|暂时不可用|不可用|已过期|已被删除|已删除|超时|加载失败|網頁不存在|找不到網頁",
    ],
    # what befell it, telling only beside a thing or the reader
    "fate": [
        _joined(_UNABLE, _DONE),
        _joined(_BEEN, _GONE),
        "is down|are down|is empty|ran out of memory|exceeds|exceeded|refused|rejected|failed|failed with|timed out|is gone|has gone|do not have permission|don't have permission|do not have access|don't have access|do not have the rights|have no rights|have no permission|need permission|not available|no longer exists|no longer available|expired|blocked|broke|crashed|too large to be displayed|too large to display|no response|no answer|unreadable|malformed|are moving|is moving|moved our|being moved|being updated|being upgraded|will be back|back soon|be right back|before headers|upstream|disconnect|typed the address|mistyped|looking for",
        _joined("blank|empty|invalid|malformed|unexpected", "answer|response|reply|page"),
        _joined("konnte nicht|konnten nicht|kann nicht|können nicht|wurde nicht|wurden nicht|nicht", _GERMAN),
        "wurde gelöscht|wurde verschoben|wurde gesperrt|abgelaufen|ist gesperrt|antwortet nicht",
        _joined("est|a été|n'est pas|n'a pas pu être|ne peut pas être", _FRENCH + "|chargé|chargée|trouvé|trouvée|affiché|affichée|ouvert|ouverte|disponible|accessible|traité|traitée"),
        _joined("no se pudo|no se puede|no pudo|no puede|ya no está|no está|no ha sido|no fue", _SPANISH),
        _joined("não foi possível|não pôde|não pode ser|não foi|já não está|não está|não pôde ser", _PORTUGUESE),
        _joined("non è stato possibile|non può essere|non è stata|non è stato|non è|non è più", _ITALIAN),
        _joined("kan niet worden|kon niet worden|kan niet|kon niet|is niet|werd niet|niet worden|niet", _DUTCH),
    ],
    # a reason that is also a common word: it tells only beside a status number
    "word": ["forbidden|unauthorized|unauthorised|gone|unavailable|conflict|notice|timeout|not acceptable|payment required|teapot|verboten|interdit|prohibido|proibido|vietato|verboden|запрещено|zabronione"],
    "status": ["error|http|status|code|fehler|erreur|erro|errore|fout|ошибка|błąd|エラー|错误|代码|código|codice|statuscode|http error"],
    "thing": [
        "page|pages|video|media|database connection|endpoint|host name|hostname|channel|profile|post|article|product|file|document|notebook|resource|url|link|address|site|website|web site|server|request|requests|service|gateway|repository|viewer|preview|content|answer|response|storage|kernel|connection|session|browser|host|proxy|app|application|system|machines|servers|reference|request id|ray|image|item|account|login|database|archive|upstream connect|headers|json|rendering|spelling|domain|network|cache",
        "seite|adresse|datei|dokument|vorschau|server|anfrage|dienst|inhalt|verbindung|sitzung|link|webseite|website|notizbuch|notebook",
        "page|fichier|document|service|serveur|requête|demande|contenu|lien|adresse|session|connexion|aperçu|site|carnet",
        "página|archivo|documento|servidor|solicitud|servicio|contenido|enlace|dirección|sesión|conexión|sitio|cuaderno|arquivo|solicitação|serviço|conteúdo|endereço|sessão|conexão|caderno",
        "pagina|file|documento|server|richiesta|servizio|contenuto|collegamento|indirizzo|sessione|connessione|sito|quaderno|bestand|verzoek|dienst|inhoud|koppeling|adres|sessie|verbinding|notitieboek",
        "страница|страницу|файл|документ|сервер|запрос|сервис|сервиса|содержимое|ссылка|адрес|сеанс|соединение|сайт|сайта|strona|strony|plik|dokument|serwer|żądanie|usługa|zawartość|łącze|adres|sesja|połączenie|witryna|witrynie",
        "ページ|ファイル|ドキュメント|サーバー|リクエスト|サービス|コンテンツ|リンク|サイト|ノートブック|このページ|お探しの|页面|文件|笔记本|服务器|请求|服务|内容|链接|地址|会话|连接|网站|网页|您|預覽|预览",
    ],
    # what such pages say besides
    "advice": [
        "try again|later|go back|return|reload|refresh|contact|administrator|support|site team|home page|homepage|start page|front page|main page|please|sorry|oops|whoops|oh no|uh oh|ups|wait|minutes|minute|seconds|second|before|next|continue|log in|login|sign in|check|requested|request|quote|owner|again|team|back|came back|behind|may read|raw|view raw|few|moment|today|soon|line|in time|limit|after|help|via|ago|until|takes about|too large|too big|temporarily|currently|elsewhere|unexpectedly|entered|typed|correct|possible|while|requesting|processing|trying|working|fix|fixing|problem|issue|issues|open|opening|see|access|permission|rights|expected|search|encountered|error|unexpected|unable to complete|complete|verify|blocker|disable|right now|anymore|moved permanently|please verify|detected|supported|switch|unusual traffic|traffic|details|learn|inconvenience|apologize|apologise|shortly|patience|maybe|could|url|typing|broken|followed|lost|nothing|hmm|having|trouble|bookmark|outdated|old|exist|status|refreshing|restart|retry|network|visit|offline|online",
        "bitte|versuchen|versuche|erneut|später|minuten|zurück|startseite|zur startseite|entschuldigung|überprüfen|kontaktieren|angeforderte|gesuchte|mehr|anmelden|melden|aufgetreten|kehren|neu laden|leider|unerwarteter|unerwartet|momentan|derzeit|aktuell|existiert|aufgerufene|verschoben|gelöscht",
        "réessayez|réessayer|plus tard|veuillez|retour|accueil|désolé|demandé|demandée|vérifiez|contactez|administrateur|minutes|connectez-vous|oups|recherchez|inattendue|actuellement|momentanément|existe|temporairement|serveur",
        "inténtelo|inténtalo|intente|intenta|más tarde|de nuevo|vuelva|vuelve|inicio|lo sentimos|solicitado|solicitada|por favor|volver|nuevamente|póngase en contacto|minutos|busca|buscas|procesar|tente|novamente|mais tarde|voltar|voltar ao início|desculpe|início|solicitada|por favor|minutos|procura|possível|inesperado|inesperada|error|erro|momento|actualmente|atualmente|existe|momentáneamente",
        "riprova|riprovare|più tardi|torna|spiacenti|ci dispiace|richiesta|richiesto|per favore|minuti|cercata|cercando|contatta|imprevisto|errore|momento|attualmente|esiste|fout|onverwachte|momenteel|opgevraagde|probeer|opnieuw|later|sorry|ga terug|terug|startpagina|gevraagde|minuten|excuses|alstublieft",
        "попробуйте|повторите|попытку|позже|пожалуйста|извините|вернитесь|главную|запрошенная|запрошенный|минут|обратитесь|запрашиваемая|запрашиваемый|запрашиваемой|временно|неожиданная|ошибка|сейчас|błąd|nieoczekiwany|obecnie|спробуйте|spróbuj|ponownie|później|proszę|przepraszamy|wróć|główną|żądana|żądany|minut|szukana|szukany",
        "後で|もう一度|お試しください|申し訳ありません|戻る|管理者|しばらくして|してから|ください|请|稍后|重试|再试|返回|首页|抱歉|联系|管理员|可能|请求的|您访问的|您请求的|刷新",
    ],
    "script": ["javascript|js|java script|java-script|scripts|scripting|script|ecmascript|cookies and scripts|noscript|javascripts|скрипты|скриптов|skrypty|skryptów|ジャバスクリプト|脚本|脚本支持"],
    "need": [
        "enable|enabled|enabling|activate|activated|turn on|turned on|turn it on|switch on|allow|allow them|require|requires|required|need|needs|needed|disabled|deactivated|blocked|blocking|turned off|switched off|does not run|doesn't run|does not support|doesn't support|not supported|must be|without|relies on|depends on|not enabled|not available|won't work|will not work",
        "aktivieren|aktiviere|aktiviert|deaktiviert|einschalten|eingeschaltet|zulassen|erlauben|benötigt|erforderlich|erfordert|voraussetzung|muss|ausgeschaltet|notwendig",
        "activer|activez|activé|désactivé|autoriser|autorisez|nécessite|requis|nécessaire|requiert",
        "active|activar|activa|activado|desactivado|habilitar|habilite|habilita|habilitado|deshabilitado|permitir|permita|requiere|necesita|necesitas|necesario|activado|tener|ative|ativar|ativado|desativado|habilite|habilitar|permita|requer|precisa|necessário",
        "abilitare|abilita|attivare|attiva|attivato|disattivato|disabilitato|consentire|richiede|necessario|inschakelen|schakel|ingeschakeld|uitgeschakeld|toestaan|vereist|nodig|activeer|zet",
        "включите|включить|включен|включён|отключен|отключён|разрешите|требуется|необходим|необходимо|нужен|włącz|włączyć|włączona|włączony|wyłączona|wyłączony|zezwól|wymaga|wymagana|wymagany",
        "有効に|有効化|無効|必要です|必要があります|許可|オンに|启用|开启|打开|允许|需要|禁用|已禁用|啟用|开启后",
    ],
    # an order to the author
    "order": [
        "insert|enter|type|add|write|replace|fill in|fill out|describe|click to|double-click to|double click to|tap to|put|paste|provide|specify|summarize|summarise|replacing|delete this|remove this|edit this|complete this|change this|drop",
        "klicken|klicken sie|geben sie|fügen sie|schreiben sie|einfügen|eingeben|hinzufügen|schreiben|beschreiben|ersetzen|ausfüllen|ergänzen|einsetzen|eintragen|insérer|insérez|écrire|écrivez|saisir|saisissez|entrez|remplacer|remplacez|ajouter|ajoutez|décrivez|complétez|cliquez pour|cliquez ici pour",
        "haga clic|haz clic|clique|agregar|añadir|adicionar|escriba|escribe|inserte|inserta|introduzca|introduce|sustituya|sustituye|reemplace|añada|añade|agregue|describa|complete|rellene|inserir|insira|escreva|substitua|adicione|descreva|preencha|digite|coloque",
        "inserisci|inserire|scrivi|scrivere|sostituisci|aggiungi|descrivi|compila|digita|klik om|toe te voegen|fare clic|voeg|vul|typ|schrijf|vervang|beschrijf|invoegen|invullen|voer",
        "введите|вставьте|напишите|замените|добавьте|опишите|укажите|заполните|wpisz|wstaw|napisz|zastąp|dodaj|opisz|podaj|uzupełnij|щелкните|нажмите|kliknij",
        "入力|記入|挿入|記述|置き換え|追加|书写|填写|输入|插入|替换|添加|描述|请输入|请填写|写入|輸入|填入|クリックして|单击|点击",
    ],
    "blank": [
        "title|project title|text|some text|answer|name|full name|student name|student number|description|short description|brief description|caption|figure caption|summary|heading|subtitle|subheading|conclusion|conclusions|introduction|dataset|data set|abstract|code|content|email|e-mail|date|author|author name|company|company name|address|phone number|section|section title|paragraph|bullet point|link|data source|source|problem|findings|solution|response|comment|comments|notes|image|picture|photo|chart|table|diagram|logo|bullet points|keyword|keywords|topic|body|body text|label|value|url|reference|references|hypothesis|project|project name|course|hand-in|firstname|lastname|first name|last name|method|results|discussion|file|template",
        "bild|foto|titel|text|name|beschreibung|kurze beschreibung|antwort|zusammenfassung|überschrift|untertitel|daten|datum|autor|projekt|einleitung|inhalt|titre|texte|réponse|nom|description|résumé|légende|sous-titre|contenu|auteur|données|votre nom|image|photo|tableau",
        "título|texto|respuesta|nombre|descripción|resumen|subtítulo|contenido|autor|fecha|datos|resposta|nome|descrição|resumo|legenda|conteúdo|subtítulo|data|dados|proyecto|projeto|imagen|imagem|foto|tabla|tabela",
        "immagine|afbeelding|titolo|testo|risposta|nome|descrizione|riassunto|sottotitolo|contenuto|didascalia|tekst|antwoord|naam|beschrijving|samenvatting|ondertitel|inhoud|bijschrift|titel",
        "изображение|картинку|фото|obraz|zdjęcie|заголовок|название|текст|ответ|имя|описание|подзаголовок|содержание|автор|дата|tytuł|tekst|odpowiedź|imię|nazwisko|opis|podtytuł|streszczenie|treść|nazwa",
        "画像|图片|图像|タイトル|テキスト|本文|回答|答え|名前|氏名|説明|要約|見出し|キャプション|标题|文字|文本|答案|姓名|名称|描述|摘要|项目简介|简介|项目|副标题|内容|您的答案|正文|標題|內容",
    ],
    "spot": ["here|goes here|go here|this text|this paragraph|this line|in this box|in this field|hier|ici|aquí|aqui|este texto|ce texte|diesen text|dieser text|qui|questo testo|deze tekst|здесь|сюда|этот текст|tutaj|ten tekst|ここ|ここに|こちらに|このテキスト|此处|在此|这里|此文字|此文本|這裡|在此处|于此|在这里"],
    "own": ["your|you|yours|my|ihr|ihre|ihren|dein|deine|deinen|votre|ton|su|tu|seu|sua|tuo|tua|vostra|vostro|uw|jouw|je|ваш|вашу|ваше|свой|своё|свое|twój|twoje|twoją|swoje|あなたの|您的|你的"],
    # what tells alone that something is still to come
    "gap": [
        "tbd|tba|tbc|to be written|to be completed|to be added|to be determined|to be announced|to be filled|to be done|to be continued|coming soon|work in progress|under construction|todo|fixme|untitled|untitled section|untitled document|untitled notebook|placeholder|placeholder text|sample text|dummy text|filler text|your text|your title|your name|your answer|your code|goes here|fill in|fill me in|click to edit|double-click to edit|click to add|insert text|insert title|insert name|replace me|change me|changeme|delete me|edit me|lorem ipsum|xxxx|firstname lastname|first name last name|your company|your logo|no description provided|description goes here",
        "platzhalter|platzhaltertext|blindtext|mustertext|noch zu ergänzen|noch auszufüllen|folgt noch|in arbeit|wird ergänzt|bitte ersetzen|texte de remplissage|à compléter|à venir|à remplir|à rédiger|en construction|texto de ejemplo|texto de prueba|por completar|por definir|en construcción|próximamente|pendiente de completar|a preencher|em construção|em breve|a definir|texto de exemplo|a completar",
        "testo segnaposto|segnaposto|da completare|da definire|da compilare|in costruzione|prossimamente|voorbeeldtekst|nog in te vullen|in te vullen|in aanbouw|binnenkort|nader te bepalen|заполнитель|текст-заполнитель|будет дополнено|в разработке|скоро будет|заполнить позже|tekst zastępczy|do uzupełnienia|w przygotowaniu|wkrótce|w budowie",
        "ダミーテキスト|サンプルテキスト|後で記入|準備中|工事中|未定|近日公開|占位文字|占位符|占位文本|示例文本|待补充|待填写|待完善|敬请期待|建设中|待定",
    ],
    # filler words, telling when said again and again
    "filler": ["blah|bla|asdf|asdfasdf|qwerty|foo|bar|baz|foo bar baz|xxx|x|text|sample text|sample|test|testing|dummy|dummy text|placeholder|filler|blindtext|texto de prueba|texto|prueba|texte|texte factice|esempio|testo|tekst|voorbeeld|muster|mustertext|platzhalter|тест|текст|占位文字|占位符|测试|示例|示例文字|テスト|ダミー|サンプル|abc|aaa|yada|hello world|something|lipsum|todo|tbd|n/a"],
    # the usual Latin of filler text
    "latin": ["lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|ullamco|laboris|nisi|aliquip|commodo|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|occaecat|cupidatat|sint|culpa|officia|deserunt|mollit|anim|est|laborum|praesent|vestibulum|curabitur|pellentesque|vivamus|maecenas|phasellus|quisque|etiam|nullam|suspendisse|aliquam|mauris|vitae|nunc|donec|integer|morbi"],
    # headings of an empty outline
    "outline": ["heading|paragraph|subheading|chapter|section|item|bullet|point|überschrift|absatz|titre|paragraphe|encabezado|párrafo|parágrafo|titolo|paragrafo|kop|alinea|заголовок|абзац|nagłówek|akapit|見出し|段落|标题"],
    # words without content
    "small": [
        "a|an|the|to|of|in|on|at|for|by|from|with|and|or|but|is|are|was|were|be|been|has|have|had|it|its|this|that|these|those|there|we|our|us|they|them|you|your|yours|i|so|as|not|no|some|any|all|do|does|did|can|may|must|will|should|would|order|use|using|view|run|see|show|shown|display|properly|correctly|fully|interactive|cells|parts|features|more|about|into|then|up|out|own|who|which|what|an|full|sentence|sentences|words",
        "der|die|das|den|dem|ein|eine|einen|ist|sind|um|zu|zur|und|oder|in|im|für|mit|von|sie|es|dieses|diese|dieser|dieser|bitte|nicht|ihr|ihrem|ihren|browser|wurde|noch|diesen|auf|an|sich",
        "le|la|les|un|une|des|du|de|et|ou|est|ce|cet|cette|pour|dans|sur|votre|vous|ne|pas|plus|afin|afficher|que|à|en|au|il|navigateur|s'est|d'",
        "el|la|los|las|un|una|de|del|y|o|es|este|esta|para|en|su|que|no|lo|por|al|navegador|ver|o|a|os|as|um|uma|do|da|dos|das|e|ou|é|esta|este|no|na|seu|sua|para|que|não|ao|continuar|por|com",
        "il|lo|la|i|gli|le|un|una|di|del|della|e|o|è|per|in|nel|tuo|questo|questa|questo|non|che|al|browser|visualizzare|continuare|de|het|een|en|of|is|om|te|in|uw|deze|dit|niet|van|op|voor|er|die|moet|bekijken|gebruiken",
        "и|в|на|для|не|это|этот|эта|этой|этого|или|что|с|по|из|ваш|вашем|вашего|браузере|браузер|просмотра|чтобы|к|i|w|na|do|nie|ten|ta|to|tej|lub|z|ze|że|aby|się|twojej|przeglądarce|przeglądarka|wyświetlić|jest|są|kontynuować|работы|продолжения",
        "を|は|が|の|に|で|と|も|この|する|して|します|です|ます|ため|ブラウザ|ブラウザー|表示する|表示|的|了|以|此|是|在|被|请|您|该|这个|个|中|后|查看|浏览器|使用|本|されました|しました|した|され|ません|います|いる|から|まで|より|页|以便|继续|才能|或|和|就|吗|，|。",
    ],
    # words that tell of an error as something that may be: such a sentence speaks about it
    "case": ["when|whenever|means|mean|meaning|tells|indicates|denotes|bedeutet|signifie|significa|означает|oznacza|if|unless|once|because|wenn|falls|sobald|weil|quand|lorsque|lorsqu'un|si|cuando|quando|se|als|wanneer|zodra|если|когда|jeśli|gdy|kiedy|場合|とき|ときに|如果|当"],
    # marks of fields: where one stands, the form of the field is looked at
    "mark": ["{{|{%|${|#{|<%|<<|[[|@@|%%|*\\||__|: __|: ..|{|[|<|【|＿＿"],
}
#: Slots whose words don't count as content.
QUIET = {"small", "mark", "case"}


def _phrases(lines: list[str]) -> set[str]:
    return {p.replace("\0", "|") for line in lines for p in line.replace("\\|", "\0").split("|") if p}


@cache
def automaton():
    """All phrases of all slots in one automaton; a phrase of several slots carries all of them."""
    import ahocorasick

    slots: dict[str, set[str]] = {}
    for slot, lines in SLOTS.items():
        for p in _phrases(lines):
            slots.setdefault(p, set()).add(slot)
    found = ahocorasick.Automaton()
    for p, s in slots.items():
        found.add_word(p, (len(p), frozenset(s)))
    found.make_automaton()
    return found
