"""The labelled lines from which the verdict on line templates is learned.

Written by hand for this project, bounded by what is listed here, and after reading the lines
of the test documents, so agreement with those documents is no held-out figure.  ``<num>``, ``<id>`` and
``<slot>`` are the masks that the template miner puts in place of numbers, of hexadecimal
names and of placeholders in template syntax.
"""

JUNK = """
<slot>
<slot> <slot>
<slot>: <slot>
[TBD - see draft]
TBD
T.B.D.
to do
TODO: write this section
to be completed
(to be completed by the applicant)
(to be completed)
to be added later
content to follow
insert text here
[insert text here]
[insert title of the invention]
enter the title here
type your text here
click here to add text
add description here
your text goes here
Heading goes here
Second point goes here
Para one goes here
Claim text goes here
Title goes here
Body text goes here
Paragraph two goes here
Sample paragraph. Replace it with your own content.
Sample paragraph. Replace it with your own content. Sample paragraph. Replace it with your own content.
Placeholder paragraph - final wording pending. Placeholder paragraph - final wording pending.
Placeholder text
This is placeholder text. This is placeholder text.
This is dummy text. This is dummy text.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Lorem ipsum nunca noctu arbitum minim sivent noctu tempora praesta ponder orbis praesta minim murex molu tempora.
Trudat nihal dolor semis fera molu semis lictum sapet noctu velit lorem fabor sapet altus conda vesti.
Velit querat tempora noctu elit tempora orbis sapet quam sapet trudat murex ipsum querat ducis praesta.
xxx xxx xxx xxx xxx xxx
xxxx xxxx xxxx
XXXXXXXX
text text text text text text
test test test test test test
blah blah blah blah blah blah
foo bar baz foo bar baz
asdf asdf asdf asdf
asdfasdf jkl; asdfasdf asdfasdf jkl; qwer zxcv zxcv asdf
qwer asdf asdfasdf qwer zxcv jkl; asdf
Mustertext Mustertext Mustertext Mustertext
Blindtext Blindtext Blindtext
Dies ist ein Blindtext. Dies ist ein Blindtext.
<hier Text eingeben>
hier Text einfügen
[Bezeichnung der Erfindung einfügen]
wird noch ergänzt
noch zu ergänzen
bitte ausfüllen
Ceci est un faux-texte provisoire. Ceci est un faux-texte provisoire.
texte à insérer
[insérer le texte ici]
<à compléter>
à compléter
à compléter par le déposant
[insertar texto aquí]
insertar texto aquí
<por completar>
por completar
Texto de ejemplo. Texto de ejemplo. Texto de ejemplo.
Este es un texto de relleno. Este es un texto de relleno.
【请在此处填写】
请在此处填写
请输入标题
（待补充）
待补充
待填写
此处填写内容
占位文字。占位文字。占位文字。
示例文字。示例文字。示例文字。
【ここに記載】
ここに記載してください
○○○○を入力してください
入力してください
後日記載
ダミーテキストです。ダミーテキストです。ダミーテキストです。
サンプルテキストです。サンプルテキストです。
[object Object] undefined undefined NaN
undefined undefined NaN
[object Object]
NaN
null
None
undefined
N/A
<num> Not Found
<num> Gateway Timeout
<num> Bad Gateway
<num> Internal Server Error
<num> Forbidden
<num> Unauthorized
<num> Service Unavailable
<num> Too Many Requests
<num> Bad Request
<num> Gone
Not Found
404 Not Found
Gateway Timeout
Bad Gateway
Internal Server Error
Forbidden
Access denied
HTTP status <num> - Bad Gateway
HTTP status <num> - Unauthorized
HTTP status <num> - Service Unavailable
HTTP status <num> - Too Many Requests
HTTP Error <num>
HTTP/<num> <num> Service Unavailable
nginx/<num>
edge/<num>
Apache/<num> Server at Port <num>
ERR_UNAUTHORIZED
ERR_TOO_MANY_REQUESTS
ERR_SERVICE_UNAVAILABLE
ERR_INTERNAL_SERVER_ERROR
ERR_GONE
ERR_GATEWAY_TIMEOUT
ERR_CONNECTION_RESET
ERR_NOT_FOUND
Error: gone (ref. <id>). Error: internal server error (ref. <num>).
Error: forbidden (ref. <num>). If this keeps happening, tell the administrator.
If this keeps happening, tell the administrator.
Error: unauthorized (ref. <id>). If this keeps happening, tell the administrator.
Error: too many requests (ref. <id>). If this keeps happening, tell the administrator.
Error: not found (ref. <id>). If this keeps happening, tell the administrator.
status=<num> cause="Bad Request" trace=<id>
status=<num> cause="Unauthorized" trace=<id>
status=<num> cause="Gateway Timeout" trace=<id>
status=<num> cause="Service Unavailable" trace=<id>
status=<num> cause="Gone" trace=<id>
status=<num> cause="Not Found" trace=<id>
status = <num> cause = " " trace = <id>
HTTP status <num> - Gone
HTTP status <num> - 
HTTP status <num> - Not Found
ERR _ 
ERR _ _
Error: (ref. <id>).
Error: internal server error (ref. <id>).
Error: service unavailable (ref. <id>).
Error: bad gateway (ref. <id>).
If this keeps happening, tell the administrator.
Licence limit reached.
The text of this publication is hidden for guests.
A subscription is needed to see this text.
Please sign in to read the full text.
Guests cannot view this document.
Warning: Undefined index: description in /srv/view.tpl on line <num>
Notice: Undefined variable: title in /srv/page.php on line <num>
Error <num>: no se encontró la página.
No se encontró la página.
Please verify that you are not a robot to see the full text.
Are you a robot?
< h1 > < / h1 > < p > The gateway gave no answer for / doc / <id> . < / p >
< h <num> > < / h <num> > < p > The gateway gave no answer for / doc / <id> . < / p >
The gateway gave no answer.
File " render . py " , line <num> , in
File "view.py", line <num>, in render
KeyError: 'title'
KeyError: 'abstract'
IndexError: list index out of range
at office.fulltext.Loader.open(Loader.java:<num>)
This is dummy copy for layout purposes only.
Dies ist ein Blindtext und wird noch ersetzt.
Sample text Sample text Sample text Sample text
Ceci est un faux-texte provisoire.
zxcv zxcv zxcv qwer asdf jkl; asdf zxcv qwer
jkl; asdf asdfasdf asdf qwer
Lictum vesti altus minim ducis nihal dolor nihal dolor dolor elit murex vesti molu velit orbis nunca ponder fabor
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
To continue, turn off the script blocker (F<num>).
To continue, turn off the script blocker and press reload.
To read this document, switch on JavaScript (F<num>).
{"status": <num>, "error": "Not Found", "trace": "<id>"}
{"error":{"code":<num>,"message":"upstream timed out","id":"<id>"}}
{"error":{"code":<num>,"message":"not found"}}
{"code": <num>, "message": "unauthorized"}
<h1>Internal Server Error</h1><p>The gateway gave no answer for /doc/<id>.</p>
<h1>Not Found</h1><p>The requested URL was not found on this server.</p>
<title>Error</title>
<h1>Bad Gateway</h1>
The requested document cannot be displayed.
The requested document could not be found.
The page you requested could not be found.
This page does not exist.
We could not find the publication you asked for. It may have been withdrawn or moved.
No results. The link you followed is out of date.
Sorry, this record is not here any more. Redirecting in <num> seconds …
Sorry, the page is not available. Redirecting …
Document not available in this collection. Please contact the help desk.
Access to this record has been blocked. Your request id is <id>.
You do not have permission to view this document.
Your session has expired. Log in again to view the full text.
Your session has timed out. Please log in again.
Please log in to view this document.
Too many requests from your network. Slow down and reload the page.
Oops! Something broke on our side. Try again in <num> minutes.
Oops! Something went wrong. Please try again later.
Something went wrong.
An unexpected error occurred. Please try again.
The service is temporarily unavailable. Please try again later.
The full text server is down for maintenance until <num>:<num>.
The site is down for maintenance.
Unable to load full text: connection reset by peer
Unable to load the document: timeout
Failed to load document
Could not connect to the database
Fatal: query failed near 'publication' (errno <num>)
Fatal error: uncaught exception
Traceback (most recent call last):
File "render.py", line <num>, in page
KeyError: 'claims'
ValueError: could not convert
TypeError: 'NoneType' object is not subscriptable
java.lang.NullPointerException
at viewer.Render.page(Render.java:<num>)
at org.example.Servlet.service(Servlet.java:<num>)
SQLSTATE[<num>]: syntax error
Warning: include(): failed opening
Erreur <num> : page introuvable.
La page demandée est introuvable.
Le service est momentanément indisponible. Veuillez réessayer plus tard.
Une erreur est survenue. Veuillez réessayer.
Accès refusé.
Votre session a expiré.
Fehler <num>: Die Seite wurde nicht gefunden.
Die angeforderte Seite wurde nicht gefunden.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Zugriff verweigert.
Ein Fehler ist aufgetreten.
Error <num>: página no encontrada.
La página solicitada no existe.
Servicio no disponible por el momento.
Servicio no disponible por el momento. Inténtelo más tarde.
Ha ocurrido un error.
Su sesión ha caducado.
Acceso denegado.
错误 <num>：找不到该页面。
找不到页面
服务暂时不可用，请稍后再试。
系统繁忙，请稍后再试。
您的会话已过期，请重新登录。
访问被拒绝
エラー <num> お探しのページは見つかりませんでした。
ページが見つかりません
ただいまサーバーが混み合っています。しばらくしてから再度お試しください。
サービスは一時的に利用できません。
セッションの有効期限が切れました。
アクセスが拒否されました
JavaScript is switched off. The document cannot be shown without it.
JavaScript is disabled in your browser.
JavaScript is required to view this page.
Please enable JavaScript to continue.
Please enable JavaScript and cookies to continue.
You need to enable JavaScript to run this viewer.
You need to enable JavaScript to run this app.
Your browser does not support scripting, or scripting is blocked.
This viewer needs scripts. Turn them on in your browser settings and reload.
To read this document, activate scripting.
To read this document, turn off the script blocker.
To continue, use a browser with scripts enabled and press reload.
To continue, switch on JavaScript.
Kindly allow scripts for this host (F<num>).
Kindly switch on JavaScript, then try again.
Kindly use a browser with scripts enabled.
Please activate scripting.
Please allow scripts for this host and press reload.
Please turn off the script blocker (F<num>).
Please use a browser with scripts enabled, then try again.
Cookies and scripts must be allowed for this patent viewer.
<noscript>Cookies and scripts must be allowed for this patent viewer.</noscript>
<noscript>Please enable JavaScript.</noscript>
Some features need scripts to be switched on.
Loading… if nothing appears, allow active content.
Loading...
Checking your browser before you continue. This takes a few seconds.
Checking if the site connection is secure
Please verify that you are human.
Please complete the captcha to continue.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
JavaScript ist deaktiviert.
Veuillez activer JavaScript pour afficher cette page.
JavaScript est désactivé dans votre navigateur.
Active JavaScript para ver esta página.
Habilite JavaScript para continuar.
请启用 JavaScript 后再浏览本页。
请在浏览器中启用脚本。
您的浏览器不支持脚本
このページを表示するにはJavaScriptを有効にしてください。
ブラウザのスクリプトを有効にしてください。
Enable cookies to continue
Your browser is not supported.
"""

CHROME = """
Home | Search | Help
Home | Search | Contact
Search > Results > Document
Home > Results > Full text
Back to top | Print | Report a problem
Back to top
Back to search
Back to results
Details >
Details
More >
Print | Share
Help desk
Contact us
Patent viewer
© Patent viewer
© <num> Patent office
Full text service
Document service
This site uses cookies. Accept all
Accept all cookies
Terms of use | Privacy
Ref <id>
Ref. <num>
Reference <id>
Request id <id>
<num>/<num> <num>:<num>
<num>-<num>-<num> <num>:<num>
<num>:<num>
<num>
--
----------------------------------------
***
Page <num> of <num>
Retry
Reload
OK
"""

CONTENT = """
The invention relates to a battery module with an annular sleeve and a first lid.
A dosing pump comprises a flexible impeller, a lower locking pin and an inner rotor.
A method for operating the memory controller is also disclosed.
The outer nozzle is inserted into the lower reservoir, so that the switching time is shortened.
The flexible lid has a thickness of <num> nm, preferably <num> mm.
In one embodiment, the outer rotor is made of titanium nitride.
Reference numeral <num> denotes the thermocouple.
As shown in FIG. <num>, the guide rail surrounds the processor.
It is an object of the invention to provide a pump in which corrosion is avoided.
It goes without saying that woven aramid can be replaced by doped silicon.
During start-up the inner rotor runs at <num> rpm until <num> °C is reached.
The control loop samples the inner coil every <num> ms and compares the value with a threshold.
If the control unit does not reach the transceiver within <num> ms, the stapler is stopped.
Known solutions require a separate waveguide, which makes the unit expensive.
List of reference signs: <num> inner ring; <num> sensor surface; <num> first control unit.
A comparison of samples <num> and <num> is given in Table <num>.
Table <num> | sample | thickness | result
A<num> | <num> wt.% | pass
B<num> | <num> mm | fail
The dosing pump of claim <num>, characterised in that the stroke can be set without tools.
The signal decoder according to claim <num>, further comprising an outer nozzle.
A method for operating a gripping tool, the method comprising: providing an annular electrode; moving the first rail.
Use of the pump according to claim <num> with a first layer.
A heat exchanger, comprising a rotor; a second manifold; and a waveguide, wherein drift is compensated.
A placeholder such as <slot> is replaced by a stored value before delivery.
The variable <slot> in the script is expanded at run time.
The notation <title> denotes the tag to be parsed.
The status TBD is stored until the calibration is complete.
The captcha module verifies that the user is human.
Dummy text (for example lorem ipsum) may be used to test the layout.
Sample text is printed in five sizes to test legibility.
If the service is unavailable, the message "try again later" is spoken.
The index <slot> runs over all channels.
The steps <slot> and <slot> may be carried out in either order.
A loop such as <slot> in the layout file is unrolled by the compiler.
The user replaces the sample paragraph with their own content.
In the log, @@ marks a frame boundary.
While the page is loading, the lamp blinks; then the session expires.
The printer fills every unused field with xxx xxx xxx.
An INSERT statement writes the measured row into the table.
The label reads «open here» in two languages.
Internal server errors (code <num>) are counted by the watchdog.
The keys asdf of the home row carry a tactile mark.
The residue Xaa may be any amino acid, written XXXX in the listing.
The display shows "please enable JavaScript" when the scripting engine is off.
A line of underscores ____ marks the tear-off edge of the label.
During maintenance of the server, requests are queued.
The string "undefined" indicates that no sensor is present.
The tag <% opens a code block that the parser skips.
The register <slot> is set by the firmware.
An exception (for example a null pointer) is logged and the drive is stopped.
An error page with the text Access denied is sent to the terminal.
A browser of the terminal stores a cookie with the session key.
The weights are <slot> for the two channels.
The error handler returns a not found message to the client.
The server sends an error code <num> when the page is missing.
A text field of the form is filled by the user.
When the script ends, the browser reloads the page.
The viewer displays the document on the screen.
● first stage ● second stage ● rinsing
[Math. <num>]
[Chem. <num>]
##EQ<num>##
[untranslated: 係止部]
y ≤ λ·<num> mol·L-<num>
$$x = { {λ}_{<num>} }$$
Q(t)=∫<num>λ
<mi>T</mi><mo>=</mo><mi>k</mi>
-CH<num>-Q<num>-(
carbon fibre was heated to <num> mm and held for <num> h
Die Erfindung betrifft eine Dosierpumpe mit einem Kühlelement und einem Federelement.
Das Steuergerät ist verschweißt mit dem Kühlelement, sodass weniger Bauteile nötig sind.
Bekannte Lösungen benötigen ein eigenes Führungsprofil.
Versuche über <num> Zyklen zeigten, dass die Leckage sinkt.
Dadurch wird erreicht, dass der Ertrag steigt.
Das Bezugszeichen <num> bezeichnet das Zwischenstück.
In einer Ausführungsform besteht das Gehäuse aus Polyamid.
Wie in Fig. <num> gezeigt, umgibt das Düsenrohr das Heizmodul.
Dosierpumpe nach Anspruch <num>, ferner aufweisend ein Rotorblatt.
Der Platzhalter <slot> wird vor dem Druck ersetzt.
Das Feld «Name einfügen» wird vom Scanner erkannt.
Ein Blindtext dient zum Prüfen der Anzeige.
Ein Mustertext wird zum Prüfen gedruckt.
Un faux-texte sert à contrôler l'affichage.
Un texto de relleno sirve para probar la pantalla.
Bei der Meldung »Seite nicht gefunden« wiederholt das Steuergerät den Abruf.
Ist der Dienst nicht verfügbar, leuchtet die Lampe.
Das Steuergerät lädt ein Skript, sofern JavaScript erlaubt ist.
L'invention concerne un capteur spectral comprenant un couvercle et un ressort.
Le palier est relié au piston, de sorte que les fuites sont réduites.
Selon un mode de réalisation, le boîtier est en acier inoxydable.
Ainsi, le rendement augmente.
Des essais sur <num> cycles ont montré que l'usure reste faible.
Comme illustré à la figure <num>, le piston entoure le levier.
Module de batterie selon la revendication <num>, dans lequel le boîtier est en polyamide.
Si la page est introuvable, le terminal réessaie.
Le champ «à compléter» est détecté par le lecteur.
La variable <slot> est remplacée lors de l'impression.
La invención se refiere a un dispositivo de sellado con un manguito y un rotor.
El depósito está conectado al sustrato, de modo que se reduce el desgaste.
De este modo, disminuyen las fugas.
Tras <num> ciclos, aumenta el rendimiento.
Como muestra la figura <num>, el sustrato rodea el depósito.
El campo <slot> se sustituye al imprimir.
Si el servicio no está disponible, se enciende la lámpara.
Dispositivo según la reivindicación <num>, en el que el rotor es de vidrio.
本发明涉及一种电池模组，包括喷嘴和阀芯。
由此，可以减少泄漏。
在一个实施例中，壳体由聚酰胺制成。
经过<num>次试验，证明可以降低磨损。
如图<num>所示，壳体包围电极。
根据权利要求<num>所述的电池模组，其特征在于，还包括电极。
变量<slot>在打印时被替换。
若返回错误<num>，则控制单元重试。
示例文字用于测试显示。
本発明は、弁体と冷却板とを備える密封装置に関する。
これにより、漏れが低減される。
一実施形態において、制御部はポリアミドからなる。
図<num>に示すように、弁体は案内溝を囲む。
ノズルの厚さは<num> mmである。
さらに蓋板を備える、請求項<num>に記載の信号復号器。
変数<slot>は印刷時に置換される。
エラー<num>を受信した場合、制御部は再試行する。
ダミーテキストを表示して検査する。
Heat exchanger
Battery module
Coating apparatus
Gripping tool
Loom shuttle
Seed drill
Cable gland
Wafer carrier
Hinge mechanism
Spectral sensor
Surgical stapler
Greifvorrichtung
Trocknungskammer
Ventilanordnung
Dichtvorrichtung
Bremseinheit
Heizvorrichtung
Séchoir rotatif
Outil de préhension
Échangeur thermique
Intercambiador de calor
Módulo de batería
夹持工具
干燥设备
涂布装置
换热器
把持工具
乾燥装置
熱交換器
This makes it possible to service the outer housing without removing the first sleeve, and cleaning is possible in place.
This makes it possible to replace the valve, and the load is spread evenly.
In step S<num>, the latch is released and the piston returns.
At <num> °C, the clamping jaw begins to yield and is held by the latch.
Where the inner housing is coupled to the shaft, a seal of graphite is provided.
Because the locking pin is offset from the diaphragm, noise is damped.
The ratio of the membrane to the electrode lies between <num> and <num>.
The gripping tool further comprises a second housing that limits the travel of the guide rail.
Tests over <num> cycles showed that false triggering is prevented.
In a second variant (not shown), the nozzle is omitted and the hub rests directly on the rail.
Contrary to the prior art, no lid has to be arranged next to the reservoir.
Die Ventilanordnung weist ferner ein Gehäuse auf.
Die Dosierpumpe weist ferner ein Rotorblatt auf.
Das Lagersitz ist angeordnet neben dem Führungsprofil, sodass die Leckage sinkt.
Zwischen dem Sensorfeld und dem Federelement verbleibt ein Spalt von <num> mm.
Das Gehäuse hat eine Dicke von <num> µm.
L'invention concerne un module de batterie comprenant un substrat et un rotor.
Le manchon est soudé au boîtier.
Un jeu de <num> µm subsiste entre le couvercle et le réservoir.
Le boîtier présente une épaisseur de <num> bar.
El manguito está soldado al cojinete.
En una realización, el rotor es de poliamida.
Under load, the lower nozzle bends by <num> bar and touches the heat sink; this is tolerated because energy use falls.
Preferably, leakage is reduced even if the upstream lever arm fails.
The skilled person will see that the inner ring and the outer ring may be exchanged.
The term "heat sink" as used herein covers any reservoir or piston with the same function.
With reference to FIGS. <num> and <num>, the manifold and the ring form a closed path.
Alternatively, carbon fibre can also be used for the housing.
导槽与阀芯焊接，从而提高良率。
所述散热板与轴承连接。
基板は弁体に隣接して配置され、温度が均一に保たれる。
ノズルと電極との間には<num> mmの隙間が残る。
基板と制御部との間には<num> °Cの隙間が残る。
軸受と筐体との間には<num> µmの隙間が残る。
乾燥装置は、さらに電極を備えてもよい。
回転子は、ノズルに固定されている。
<num>回の試験の結果、歩留まりが向上することが確認された。
蓋板の厚さは<num> kΩである。
前記制御部は窒化ケイ素からなる、請求項<num>に記載の信号復号器。
散热板与阀芯之间留有<num> mm的间隙。
弹性件的厚度为<num> µm。
壳体与控制单元固定，从而减少泄漏。
一种密封装置，其特征在于，包括阀芯、散热板和盖板，从而提高良率。
El rotor está montado en el depósito.
El sustrato tiene un espesor de <num> mm.
El manguito está conectado al cojinete, de modo que disminuyen las fugas.
Le levier est disposé près du substrat.
Le rotor présente une épaisseur de <num> mm.
Das Rotorblatt ist befestigt an dem Heizmodul.
Template rendering server
Error correction circuit
Signal decoder
Page printing device
Script controlled robot
Dosierpumpe
Batteriebaugruppe
Capteur spectral
Module de batterie
Dispositivo de sellado
Secador rotativo
電池モジュール
密封装置
信号解码器
Dr.
FIG. <num>
(<num>)
of claim <num>
CLAIMS
DESCRIPTION
ABSTRACT
"""


def lines(block: str) -> list[str]:
    return [x for x in block.strip("\n").split("\n") if x]
