"""English words, the most used first, counted in comments and docstrings of Python's library."""

ENGLISH = """
the for and with not that this are from use one can should when all only will file but may which used have more type
value object see test has return default class same string function list work name https data values set case using
copy check either non you under other first any like here specific into license does was error code also module
information must because method need copyright required get than except given some then new its number call without
http before after where each result make empty raise there returns instead different these ignore additional types
both single two tests import input names they writing just example support int since language str order would obtain
argument objects out time functions always distributed defined present sure them instance output passed called
specified self end tuple version software path details line index applicable already exception arguments returned
optional avoid implied multiple permissions methods match following strings compliance otherwise been express
limitations valid such found based create want law agreed pass add even whether governing regarding array between
cannot last current contributor ownership still uses user expected licenses agreements cases original back contains
format level attribute possible through now available works integer being source implementation dict length could
change part dtype raised run key float invalid above needed bool provided size over about start try most directly way
their supported point created files noqa raises ensure parameter handle containing fail behavior bytes our calls too
what column allow below right means while another text read added once errors python issue via results sequence might
special generated correct keyword message standard second testing classes zero during missing those numpy contain
dictionary attributes well else columns reference true actually base removed include calling were compatibility block
how characters equal setting mode per done convert keep element remove fails least style within currently variable
never elements explicitly find warning itself next including allowed process team many long parameters until running
pygments needs correctly state common left existing memory bit necessary equivalent character corresponding directory
def reserved keys write full take skip encoding arg converted actual off matches useful range extra options lines
exist tuples item args ignored mapping simple exists form instances later local subclass package versions deprecated
internal times note context something root pandas every inside rather numbers etc func takes checks sys scalar rights
matching changed override allows due operation against handling defaults option requires checking nothing binary old
around large boolean buffer anything custom unique items automatically cache system place cause attr makes table yet
passing interface representation unless field param underlying gets own exceptions entry less arrays various very
integers lists returning named constructor stored bug access nested provide exactly operations again built cover fixed
loop cast future changes related logic model dtypes shape parent sets parse negative variables top fields versionadded
specify know written real longer callable replace normal similar byte position relative build datetime implemented
included supports numeric inputs conversion extension modules require better handled provides comparison row
appropriate count parsing pragma previous environment header generate small enough resulting modify though subclasses
considered expression close wrong made safe maximum creating prefix series known ndarray explicit assignment complex
global compatible side space library usage kwargs properly assume regular look really info three apply compare treated
bpo open flag define happen protocol assert includes update adding unicode target iterable rows give location applied
syntax namespace metadata false depending documentation closed indices content limit paths trailing multi log probably
random reading initial your whose representing double entries command whole particular offset thread able implement
determine map preserve control frame store encoded separate much happens show group effect filename sort precision
performance break contents complete appear possibly prevent behaviour starting produce things main failed shared
points expect pattern arbitrary terms attempt stream users null ones print iterator mixed basic date replaced checked
node label parsed axis according final across references outside having leading gives sorted few property exact lower
difference operator messages installed listed obj search accept pre alias duplicate imported width taken entire down
enabled handles creates comment doing everything public examples short starts collection trying associated split along
generator structure raw platform generic verify definition tested simply floats general max consistent put builtin sub
load keywords backwards rest failure wrapper configuration display properties wrap bad warnings larger stop modified
manager wrapped ints signature algorithm positive compute parts positional condition making likely pair issues bound
going nan working whitespace implementations previously absolute represents pairs accepted encodings supplied slice
preserved child mask addition represent filter good subject did specifying handler stack seconds usually together
request fix section requested desired event had construct depends ref reason reset fast script view best accepts mean
got beginning others overflow immediately functionality proper trigger blocks thing save problem minimum total parser
certain caller perform processing cached remaining let crash server kind union backward help runs occur iteration fill
step none constant lambda indicating fully internally connection therefore rules sequences validate fall temporary
private loaded raising doctest indicates clear execution scalars hash manually validation docstring labels faster
ordered converting decimal consider occurs important imports relevant follows several greater leave updated runtime
floating followed platforms unit enable intended disabled disable incompatible hold comments adds further twice
unknown compiler ensures report copies levels creation force mypy catch looks helper nodes thus identical causes
bounds copied infer schema exit formatting indexing contained spaces newline flags repr recent round socket move
higher yield overridden indicate detect config follow plain treat assumed ends unchanged semantics descriptor skipped
resolution fit codes guaranteed bits words formatted distribution operators assigned systems release meaning low
append determined separated ordering subset fallback meth represented pyarrow literal fine features project select
seems expressions headers registered interpreter tree generally inference pytest spec address smaller foo statement
exclude native lookup legacy high body utf purpose broken slow implements packages come external aliases timezone
regex casting specifies sum applies compiled drop normalized extract earlier inferred timeout defines executed token
insert decorator dependent delete separator holds query callback incorrect typically escape deleted problems older
compared printed deprecation dataframe threads produced bar described suite dimension requests response purposes
direct formats feature git specification looking changing outputs identifier switch ops inner produces care become
constants graph groups window normally send directories aware individual account anyway digits word forward kept
regardless comparing computed timestamp wait why versionchanged debug char selected however equality implicit derived
traceback session track getting doc third branch easy indexes free categories core client description console turn
repeated optionally tag regression neither initialized reads alternative recursive reduce share interpreted resolve
goes contributors combination sample readable color performed maps amount sense mark conditions record settings
assumes duplicates refer reverse dimensional affect maybe expects appears keeps setup hook sent overrides freq
categorical sizes taking register comes appended nor construction strict depend matter pickle potentially offsets
importing compat min counts combinations constructed optimization deal extensions sometimes partial becomes continue
engine document scope plus reasons padding suitable status zeros encode speed batch saved prior limited comparisons
invoked docs rule breaks pyspark dimensions silently successfully interval period early timedelta fact sign tokens
recursion program separately machine omitted passes typing dataset past wrapping selection axes extended rely quoted
cycle children application caused embedded execute often clean little failing components away big assign received
naive respectively converts loading hit seen coding replacement tries models spark link wise hard category static ever
signal dicts ways cls avoids unused scheme recursively closing reuse upon misc processed collected calculate terminal
struct inherit matched filled moved auto member stuff chunk stdout reported dropped inherited garbage outer started
host comma subsequent ascii marked matrix positions day pip decode suffix params debugging sorting minimal signed
allowing restore opened reached strip chosen hence recommended port infinite chunks easier necessarily convenience
optimized edge printing distinct tell propagate throw implementing product ignoring component abstract patterns
unsupported accessed inplace windows lexer mod upper far vector almost unexpected expensive unsigned active
specifically dates quite resolved disk filesystem themselves warn undefined tags annotations behave increasing mapped
dir mechanism identity dot boundary applying quotes install pretty cleanup supporting container especially insensitive
slightly shown url title serialized chars records coverage configured generates overwrite computing join domain differ
efficient collections designed escaped responsible evaluated storage resource half arithmetic arr blank truncated
subprocess supposed overlap requirement building latter assuming contiguous frames members presence lengths database
calculated updates json recognized succeed newlines completely detected shows say origin middle definitions writes
merge generation connect events normalize encountered mostly initialize frequency processes inserted dependency
guarantee hack retain attempts preferred background var providing decoding independent stderr places four stable
iterate corner incorrectly generating hashable differently builds dictionaries notice broadcast letter smallest pure
chain weights annotation libraries failures inspect choose whenever replaces coerce fixture linear identifiers weight
major alive groupby decoded guess overhead defining locale accessing pop literals among visible shutdown languages
collect approach priority dynamic aligned math statements behaves meant power alignment consistency permission device
preserves please precedence excluded caught leak align opening locations buffers storing occurred marker duplicated
summary handlers post cross immutable indexed wraps calculation corresponds year depth successful elsewhere
dependencies proxy pickling respect introduced repeat initialization quote whatever inf variant box lost evaluate
reader finished pointer receive removing ambiguous improve giving displayed documented finally transform hand remain
division circular obtained potential replacing evaluation backed largest vary unlike factory lead term eventually page
requirements yields strategy combined dynamically caching whereas differences computation decorated col deep tensor
resources triggered equals entirely reasonable dummy utility executing rank logging unnecessary export descriptors
merged msg overriding nice segfault sensitive globals think sanity init val remains action typed numerical strictly
limits maintain network ending causing workaround rounding forms days nearest lock keeping usual refers inverse zone
mismatch magic slicing satisfy relies stdlib digit hex ignores patch layout mock square safely emit copying trace
nullable scale factor highlight commands stripped implicitly held filling units formatter determines combine says
verbose partially seem task reversed invoke registry prevents executable filters enforced stores weird figure
structured enum idea significant extracted bugs kernel capture breaking mix instantiated suppress consecutive
boundaries choice newly threading pylint statistics consume pool steps modes bare compile referenced indexer
compression prints gencodec sending idx turns shapes filenames waiting serialization trip writer cleared thrown expand
detail appropriately success inline consists training wheel blocking queue extend correspond month excluding datetimes
exc builtins identify highest tools lot begin assertion unittest distinguish triggers minor logical located height
template pick attempting lazy ready average concrete slices careful operate practice locals addresses truncate exposed
differs tab epoch links completed originally streams parsers partition remote sources although beyond len nans
timestamps leaves lowercase finish prefer emitted experimental affected monotonic odd placed adjust arrow states
symbolic consumed removes symbol mutate shell retrieve backslash acceptable interactive front easily transformed
temporarily separators human ids hooks pipe colors soon indentation discard kwarg structures terminated partitions
worker perhaps helps ndarrays untyped constructing writable alone decide tables threshold wide controls variance
conflict prompt intermediate wants mainly duration occurrence distribute virtual issuecomment loops usable styles
policy email falls meta alternate stdin turned expanded succeeds routines symbols lowest allocated reporting direction
reduction onto indent constraints operating holding dispatch impossible effects retained ufunc fewer hidden markers
masked generators sized discussion algorithms terminate std singleton colon hypothesis callbacks plugin overlapping
anymore mutable vectors delay retrieved sparse effectively combining reach showing released dim zip casts dealing
increase ranges streaming meaningful operand shift seed preserving explanation submit implies rename attached
parametrized cols render modification conversions bottom specifier site roundtrip redundant applications routine
qualified skipping sentinel binding detection convention moment head race interesting slower notation covered finding
solution escapes reshape describing completion performs validated helpers filtered insertion updating somewhat coerced
prefixes reports shorter pending newer splitting governed views filtering overload indicated widget someone hide
inclusive notes shallow expose backend installation kinds subtype interpret connections covers importlib detailed
finite accessible microseconds releases modifying interchange distributions ser leaving deterministic appending
compliant lose conditional loader draw pyright serialize coercion attention layer throws situation ascending granted
del docstrings indicator compressed periods flattened alter destination sufficient portion counting probability cost
instantiation canonical approximate near convenient segment automatic pseudo overwritten pad onnx underscore
continuation grouped machinery belongs booleans complicated inserting diff pos flexible cycles illegal remainder
hostname effective act dont expressed tricky determining describe closest dataclass metaclass async normalization
incomplete grouping mutated iterating inherits forces tasks family choices leads respective propagated multiplication
caches observed attrs cell simplify exported span archive worth upcast who subclassing rare technically fresh
descending exclusive transformation brackets stops enables password codec signals unlikely representations fbs frozen
party alpha env knows ask fetch populate torch initializer shall exercise performing pickled letters declaration
parallel stopped flat likes declared fraction indented num chance trivial simpler scripts lets accuracy pydantic flush
populated adapted blocked dump highlighting disallowed nesting schemes accurate security worked linked reject endian
void exceed nulls milliseconds risk destroyed loss authentication invocation coordinates abc ensuring broadcasting
reliable predicate transition connected effort limitation configure bias bases instantiate recognize tried huge ufuncs
stay progress minus slash unsafe reused transpose hashes particularly constructors renamed compares mappings documents
prefixed white reduced hour dots saving wrappers signatures decoder swap relatively belong buffering cleaned bind
producing variants ourselves integral moving unset nanoseconds samples basis html attempted minutes opposed imaginary
programming involved estimate batches finds decreasing astype delimiter font inconsistent answer unpack timezones came
asyncio encoder similarly eval wish buffered aggregate tempfile evaluates exponent affects triple optimize sync
falling candidate quickly defs retry iterators sends cursor deviation attach symlink annotated omit legal cells
requiring initially integration uppercase trick discarded aggregation baz nonzero latest counter typical drops hint
vars plugins tabs pointing loc iterables controlled iff unconditionally introspection internals metrics constraint
occurrences lib ahead tensors enforce towards selecting dev api utilities calculating multiline sockets deleting
iterations mess channel tool segments ctypes joined analysis bin searching datetimelike hours symmetric obvious closes
payload startup validator verification anywhere forced despite rejected sharing accordingly intentionally happened
area slot disallow situations conflicts fits ndim computes infinity possibility overflows sides issued reflect
intersection yielding intervals clause shortcut existent okay guide rich interpolation highlighted chained functional
unspecified fractional clock parses lazily locally submodule essentially collector temp captured primitive adjacent
expansion lookups xref defer cat preceding exits allocation rounded hints formed guard tells tracking scaling super
piece redirect constructs datatype assignments helpful week identifying ability guarantees describes advanced
converter callables primary translate lexers managed threaded reconstruct coroutine strategies res rid printable bunch
malformed roughly hereby sections marks specially specialized pathlib bins dropping treats continuous charset looked
invariant proxies spurious parents tolerance acts xml editor transport design concat parentheses scipy matters
delimited quantized interaction rewrite existence lineno classmethod sampling packed repository selector median elif
drawn age fairly assumption divide atomic setuptools naming manner respected containers recurse coefficients bools
skips disables hang inheritance behind itemsize concurrent bother repeatedly splits confusing exhausted history
restriction weak fragment service folder recorded grammar underscores packaging conform mismatched quantile recommend
concatenation chunked crashes gone simulate readline resolving job couple phase functools counted engines weakref
tzinfo friendly fake valued course primarily percent exceeds drive pieces dotted understand smoke reproduce parquet
anchor discovered htest protected symlinks callers certificate pipeline mimic receives independently commonly
consisting concatenate manual matplotlib adjusted transposed identified altered quick representable satisfied
framework measure surrogate efficiency strong afterwards registration abort leaks specifications rolling calculations
prepend exited folding dense increment undocumented interfaces people cython manage setitem increases cut auth
permitted responses accessor screen modifications verifying restored reduces matrices treatment randomly concatenated
accepting csv proto servers former downstream unpacked subgraph fusion invoking powers cancelled years optimizer fork
dataclasses suppressed forever floor lack complexity achieve edges image flow bytearray markup getitem dateutil extras
commas specifiers selects fold hierarchy upstream unable namedtuple decorators preference maintained verified supply
region contexts tracebacks queries unix aka unavailable natural logger padded live stats assigning sliced minute
frequencies evaluating driver scan accidentally involving provider repeats theme master environments mutating author
distance entered fixing uniform prediction asked squared allocate iterated unpickling bogus sep dead rtype presented
logged predictions unrelated runner rendered strange individually hierarchical vertical translated doctests prepare
efficiently coming deferred transformations relying thought nanosecond transfer subtraction multiply horizontal
datasets bytecode coefficient weighted correctness degrees skipna assertions dropna basically ideal subtract err
simplest advance physical profile verifies cancel tail somewhere mixin microsecond improved inspired convertible
proceed indirectly late grid conflicting slots checkers pathname rendering center superclass prepended buf signs
backslashes urllib deliberately absent unpacking fused initializers modern delta reflected decimals comparable worry
goal capturing arbitrarily theory unary yielded shrink home punctuation hexadecimal protect gap scenario singular jump
sorts quoting precise quantization candidates finalization converters instantiating products indexers reindex sleep
download renderable black solely red modulo plan multiindex compact catching button optimizations zones facing unwrap
casted consumes opt expecting conventions exposes collecting simplified actions plot substitute varies polynomial
operands circuit vectorized fancy errno wanted directives strides reductions opposite subclassed triggering seek
registering equally consist magnitude expanding masks bindings beta exports validators localhost safety world
heuristic unhashable sensible urls vice versa considering recreate yes resolver ast interpretation extends
approximately unbounded ordinary commit development namespaces accesses fee impact exec listing submodules buggy
merging stage observations await redirected machines confirm interrupted everywhere hopefully cased shrinking modifies
memoryview searched nature unmodified codecs unbound endianness spacing straight classification wrote substring pull
difficult refs emits globally dual escaping elementwise trim lots web clients edit longest distinction transformers
met timer nano validating plotting identically supertype partitioning promote delegate puts swapped truncating opens
robust pid excludes reliably universal timing retries approximation score play overall compilation inheriting bracket
standalone reaches readonly writeable resets unordered directive menu delimiters pickles suffixes closure semi
principle architecture emulate varying fitting distutils configurations licensed correlation unequal chaining drawing
braces ordinal weekday protocols serializable kernels onnxruntime bytestring gzip multiprocessing five treating
scenarios fault ugly stripping importable restrictions compress compound appearance fastpath ratio partitioned
backport dialog masking builder mutually relationship stateful macro glob timeouts timedeltas spaced username shifting
transforms dst decision joining begins irrelevant hits reorder sequential const exiting anyone fmt analogous promotion
gracefully labeled loads favor hashing customize needing mentioned minimize placeholder dataframes bold saves
idempotent serializer dedicated truth fashion performant ideally solve simplicity feed keyed sees coordinate executor
bypass clears definitely orders satisfies demand expr discrete choosing unreachable completes asynchronous bounded
mutation question exponential renaming outcome receiving observation truncation preceded displays declarations enter
defaulting seq src comprehension incoming calendar targets disabling getattr commented instruction ssl midnight
diagonal authors latin conjunction cumulative fillna multidimensional isinstance cert displaying removal tokenizer
dist initializing localized executes scheduled downloaded thousands measured soft reload prepared archives wheels
complain fetched editable exceeded programs lies consistently folded unfortunately reasonably deprecate datatypes cwd
bitwise stacked happy extracting transforming spawn miss assumptions redirects border posix leap benefit encounter
inserts confused uniformly tracing profiling fixtures workers claim mixing freed overloaded refcount footer opset
consumer consumers blow introduce subtypes encodes avoiding avoided validity flaky percentile inferring formatters
flatten cleaning nonexistent official restricted instructions forbidden mapper overwriting schemas said established
mtime equivalence searches installing lacks referred fitted remember digest wider resultant rarely simultaneously
whitespaces bail consuming existed octal absence pages coerces rate finder protobuf prog divisor replacements listlike
manipulation consumption deeply enabling vals push deadlock appends clone six recently numba destroy somehow forwarded
pow locks persistent obtaining narrow optimal forcing declare frozenset stat operates undo frequently discover forget
apart squeeze decodes scaled immediate suggested iloc pytz catches unions translation coercing great ended wildcard
bigger tagged moves respects bucket reindexing unnecessarily extending patched mouse logs shorthand dims room evenly
derive ext wins duplication serializing homogeneous ran multipart overwrites parenthesis installs zipfile shifted
putting backing owner waits registers ties roots sufficiently fixes warns accumulate enclosing branches connecting
intent cluster resolves rightmost monotonically confusion invalidate entering hosts problematic carry reachable
endpoints extremely clearing deletion prompts apparently equation teardown trimmed management multiples launch nth
separating oriented demonstrating leftmost stacklevel dash subdirectory carefully achieved templates interrupt
customized clearly duck informative sane useless regrtest tied validates parametrization referencing kwds hardcoded
additions friends happening finishes unusual pack purely closer picked highly maintains quiet sessions positives
tracked handshake life reso transformer fed linux circumstances portions serves abs rounds resize surrounding
categoricals ticket examine chunksize diagnostic managing slashes unnamed derivative traditional quantize shortest
transitions surrogates stays ambiguity classic surprising marking sampled subtle quantiles light collisions domains
worse cookie regexp trust trouble shim inject walk trees fastest endif primitives projection shuffle mimics identifies
invocations leaf summed unaffected coded interfere structs restores idle ravel losslessly ddof whichever upgrade
heavily merely mistake satisfying scanning indeed predicates draws iso rejects stride histogram intercept processor
silence differing propagation logically advantage pypi propagates denote monkey eps cancellation sql explained stub
triples rng business degree touch invokes stopping dirty fragments interested boxes stray resetting div unclear
factors localize req widths strips concept unambiguous browser conf exp lone intact projects straightforward picklable
downcast translates regexes termination terminating destructor dunder rhs embedding parametrize historical typ rdd
pointed subinterpreters involve checker opcode github enclosed cond ftp uncompressed acquire reordered succeeded
subdirectories baseline accumulated wake multiplied endpoint roll cyclic die formula ruff emitting repeating shares
latency dest offers unlimited agree occurring certificates coroutines uint backends ellipsis conforms alphanumeric
discovery composite managers providers tkinter understood insensitively patching conn wall descriptions tick
membership linecache bootstrap variation yourself decides additionally solved loses manages surrounded renders cookies
hope conforming turtle checkpoint reducing walking listening residual fourth stricter anonymous modifier segfaults
redirection clip leaked honored aliased parity exporting scales annotate natively face lives externally corrupt
complement dog costly covariance refactoring denominator rebuild broadcasted keepdims throughout terminates
conservative fly toplevel introduces scanned criteria compiling interest learn handy merges debugger thanks cpython
opaque dividing generics obsolete spam infers upcasting agg stale dimensionality requesting strftime transparent
obviously utc margin pointers weighting opcodes population configurable unregister locked egg collects behaviors
squares communication percentage deepcopy ctx filepath stick innermost unhandled subsequently lowercased transaction
deletes owns deserialized certainly nrows lambdas greedy fuse preparation ought trusted unpickle preventing exposing
shot heap entity infinities aggregations fills plots interpreters rewritten told analyze quit literally flushed
uninitialized dup klass estimator invert setter popped considers sysconfig kill believe pipes rewind inspection
refactor incremented subtracting increased critical retains possibilities concatenating extracts badly annoying prune
dirs expands epsilon spans doubles explain eager tracks lifetime barrier detects unified macros spelling basename
normalizes pdb capable classmethods versus speedup casing estimated elapsed central configuring idlelib tzdata wire
httplib man recover scopes searchsorted usecols glibc variety quality widgets circle norm excel cpu enumerate inexact
dangling eliminate uniqueness cap angle desirable adapter silent restoring ranks unwrapped supplying substrings blue
manipulate tabular css comprehensive expired losing uri pinned poor argparse developer divisible namedtuples finalizer
reshaped scoped captures stacking fractions shadow delayed involves overloads denotes referring cartesian intp aspects
divmod repetitions pairwise app numerically lookahead scores thereof backtracking polynomials chunking promoted
traversing verbosity xdist rewriting establish foreground discarding finalized cleanly fatal dups vertically summation
querying frequent joins mirrors normalizing counterpart estimates overlaps heads channels alphabetically predefined
extreme xxx significantly java mandatory descendant predicted permit collision collapse isolated byteorder alongside
nicer grouper meet months equivalents dance titles mechanisms freely flavor throwing maintaining arise noise numbered
alternatively portable divided decided tzaware discouraged queried initializes mirror integrate dashes bars standards
adjustment controlling sourcecode green secure allowable unquoted poorly asking boxed reconstructed switched argv mind
oldest bundle serve stuck anchored suites executors indirect mail reprs numexpr persist animal freedom delegation
unbiased correspondence discards aggregating reshaping buildbot endings variations filesystems reaching buildbots
incremental pin cumsum procedure colons alert replay encodable enters cheap arraylike consolidated locate person
combines pdf grow catalog virtualenv outermost abbreviation subsets peer texts improvement seeing strongly daemon
encrypted paste trained vendored substitution flexibility guessed argsort integrated hardware interact hello injected
utils staticmethod hyphens truly grab perf daylight jumps longdouble iter practical stand pertaining browsers eagerly
responsibility popular parameterized thinks refuse activate erroneously mocked linearly historically click gui
borrowed looping skew pickleable nonnegative factorization calculates besides agreement cmd estimation ret dark
notebook suppose latex thresholds visibility brace databases futures graphs metric logits truncates accurately
unpickled suggest specs util shutil fds lhs directions plane subplots deeper paired deg uniquely accounts
continuations pyc star traverse lexical tokenize pivot com explode venv spawned mocks flushing atexit prime knowledge
quotient sqrt equiv swapping complains semicolon perfect harder missed organized quadratic verbatim concern inclusion
peak asserts finalizers pyshell mismatches underline activated dialect opener resume reproducible editing claims
capability gotten zeroes superset devices disallows notified holes denoting shaped chains paragraph ditto zoneinfo
dispatched forwards cats tweaks resample injection overview confuse composed micro gain closely mat wild contrast
affecting impl jobs conftest deque ticks abbreviated imply alphabetical unescaped exceeding went blanks packing worst
recording stages demonstrates toward inspected untouched patches behaved aligns interpolate hiding mid amounts
unrecognized deals belonging tripping internet cuda permutations layers answers replicate alternatives sin weakrefs
predictable pushed unstable org developers decorate secondary segmentation defaultdict sums syntactically developed
defaulted subprocesses net issuing libc poll ish symmetry lang strided testcase grows relation retrieves proposed
statistic precisely denoted computations survive appearing detecting subarray shrinks xfail syscall codepoint psdf
accidental statistical seekable substantial leaking contact extraction ill timed recognised hasattr vim demo underflow
subnormal modifiers shebang pretend turning reraise maximal exhaustive unneeded pyproject maxsize inefficient
perfectly revision win easiest analogue resized serial focus iterates substitutions nonempty linalg lbnd decomposition
technique discussed tip advertising substituted gateway enums gathered adapt schedule gaps heterogeneous hitting
singletons snippet unfortunate respond flushes listener www refresh tmp indicators materialize encounters ness pep
freeze iterative credentials scheduling interacting sdist ffill restrict highlights selectors caption midx keyboard
infrastructure extraneous commutative bundled repetition vcs positionally cores multiplying cmdline overflowing
mismatching bootstrapping unwanted consolidate binds differentiate dealt visit busy asynchronously notify violation
uniques omitting capitalized duplicating contract notable nearly preprocessor letting proc scientific reflects
abstraction defect tiny ceil hyphen traversal structural switches relied retrieving took slowest foreign terminals
paper checkout traced flip dumps rationale reentrant semantic persistence density book learning architectures
timeseries subroutine pointwise freqs rtol uid eight offending dirname stability carries subarrays disappear addr
inverted consequence production online pasted geometry collapsed resampling arising recarray subscript propagating
getter presumably unreliable onwards deserialization formerly unaligned stands fsspec justify nonlocal weeks diffusion
resort curly linking statically hangs redistribute blob identities daily prohibited fname deltas insufficient images
caution myself millisecond thin lenient wink encapsulates quarter unaltered dictates abbreviations sheet spread
absolutely corrupted zlib checksum seeking till nanos grained continues publicity aggregated ten algebra van
mathematical cov benchmark textual nocover inspecting heading gave capabilities iteratively interpolated descriptive
unicodedata became wildcards essential declares pkg seealso contribute reindexed locales bfill sticky placement
manipulating uuid italic noted gradient terminator strs cope reality expires isolation downloads chooses fetching
malloc completions orient clustering hacky outfile rotated scatter offer readers datetimetz counters redef phrase
separates bodies revert freshly isin selections namely frozensets introspect mocking unbuffered exhaust fragile
hanging killed bufsize acquired neg floordiv ceiling continued parallelism reusing alphabet guards role aborted
qualname prod opts incrementing benchmarking recompute powerful rejection precede ansi inequality connects inlined
cancelling shut probabilities country concurrently desc doubled launched mixture dangerous accounting stmt
semantically predict asserting harmless allocations deallocated graphics refactored pydoc preservation broadcastable
queues serializes viewed udf geometric buckets accessors transmission outcomes successive cheaper unfinished bitmap
unsorted paren fileobj curses fun accommodate intentional placing producer certs savings stronger clash retrieval
flows liable warranty appreciated pruned reloading altering roundoff dedent visited clipboard vendor gamma signifies
targeted heavy translating deliver declaring hardcode centered sake expectation pypy embed companion sec enhanced
unusable hood denied viewing gdb hot isna memo dispatches regenerate manifest correction anchors ported comprehensions
reordering invisible entities digests fallbacks understanding everyone everybody plainly invited sorry tomorrow
yesterday today weather
""".split()
