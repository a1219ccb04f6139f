from strandframe.cli import main

main()
